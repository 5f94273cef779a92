"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import fixed_values as V
from ..functions import predicates as P
from ..functions.hashing import frac, held_out, pick, pick_from
from ..functions.text import normalize_source
from ..operators import metrics as M
from ..operators import vocabulary as B
from ..operators.splits import first_of_copies
from .dialect import byte_sql, quote, u32_sql
from .on_extract import gold_and_answer
from .on_filters import VERDICT_SQL, _SHORT_SQL, code_rows
from .registry import query

def n_rows():
    return F.count(F.lit(1))


@query("corpus_stats", f"""
    WITH d AS (SELECT CASE WHEN {byte_sql('text')} % 40 = 0 THEN 'val' ELSE 'train' END AS split, source,
        len(string_split(text, ' ')) AS n FROM documents)
    SELECT split, source, count(*) AS docs, sum(n)::BIGINT AS tokens, min(n) AS shortest, max(n) AS longest
    FROM d GROUP BY ROLLUP (split, source)""")
def _(t):
    side = F.when(held_out(F.col("text"), V.REASON_HOLDOUT), "val").otherwise("train")
    return (t.documents.select(side.alias("split"), "source", F.size(F.split("text", " ")).alias("n"))
            .rollup("split", "source").agg(n_rows().alias("docs"), F.sum("n").alias("tokens"),
                                           F.min("n").alias("shortest"), F.max("n").alias("longest")))


@query("kept_dropped_report", f"""
    SELECT source, coalesce(reason, 'kept') AS outcome, count(*) AS n FROM ({VERDICT_SQL}) v
    JOIN documents d USING (doc_id) GROUP BY ALL""")
def _(t):
    return (code_rows(t).select("source", F.coalesce(P.file_verdict(F.col("ext"), F.col("x")), F.lit("kept")).alias("outcome"))
            .groupBy("source", "outcome").agg(n_rows().alias("n")))


_COPY_SQL = "CASE WHEN doc_id % 4 = 0 THEN text || '  ' ELSE text END"


@query("exact_dedup", rf"""
    WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY regexp_replace({_COPY_SQL}, '\s+$', '') ORDER BY doc_id) AS rn FROM documents)
    SELECT doc_id, source FROM d WHERE rn = 1""")
def _(t):
    # A quarter of the rows get blanks at the end, which do not make them another text.
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("  "))).otherwise(F.col("text"))
    kept = first_of_copies(t.documents, F.md5(normalize_source(text)), "doc_id")
    return kept.select("doc_id", "source")


@query("ci_dedup", f"""
    WITH d AS (SELECT doc_id, {byte_sql('doc_id::VARCHAR')} % 6 = 0 AS held, CASE WHEN doc_id % 2 = 0 THEN 'ABC ' ELSE 'abc ' END || text AS x FROM documents),
    r AS (SELECT doc_id, held, row_number() OVER (PARTITION BY lower(x) ORDER BY doc_id) AS rn FROM d)
    SELECT CASE WHEN held THEN 'val' ELSE 'train' END AS side, doc_id FROM r WHERE rn = 1""")
def _(t):
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, "ABC ").otherwise("abc "), "text")
    side = F.when(held_out(F.col("doc_id").cast("string"), V.ROUTE_HOLDOUT), "val").otherwise("train")
    rows = t.documents.select("doc_id", side.alias("side"), text.alias("x"))
    return first_of_copies(rows, F.md5(F.lower("x")), "doc_id").select("side", "doc_id")


@query("char_vocab", """
    WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents)
    SELECT (row_number() OVER (ORDER BY ch) - 1) AS id, ch FROM c WHERE ch <> ''""")
def _(t):
    return B.char_vocab(t.documents, "text").select("id", "ch")


@query("pretoken_counts")
def _(t):
    return B.pretoken_counts(t.documents, "text")


SPECIAL = [V.DIALOG_SEP, V.CHAT, V.END]


@query("bpe_learn")
def _(t):
    merges = B.bpe_learn(t.conversations, "text")
    rows = [(i, a, b) for i, (a, b) in enumerate(merges)]
    return t.spark.createDataFrame(rows, "rank int, a string, b string")


@query("bpe_encode", f"""
    SELECT conv_id, turn, '{V.CHAT}' || text || '{V.END}' AS decoded, true AS same FROM conversations""")
def _(t):
    merges = B.bpe_learn(t.conversations, "text")
    rows = t.conversations.select("conv_id", "turn", F.concat(F.lit(V.CHAT), "text", F.lit(V.END)).alias("x"))
    ids = B.bpe_encode(rows, ["conv_id", "turn"], B.special_pieces(F.col("x"), SPECIAL), merges, SPECIAL, keep=["x"])
    back = B.bpe_decode(F.col("ids"), merges, SPECIAL)
    return ids.select("conv_id", "turn", back.alias("decoded"), (back == F.col("x")).alias("same"))


# ------------------------------------------------------------------- metrics
_ROUTES = "[" + ", ".join(quote(r) for r in V.ROUTES) + "]"
_U = {s: u32_sql(s, "doc_id") for s in ("gold", "pred", "hit", "conf")}
PREDS_SQL = f"""
    SELECT doc_id, ({_ROUTES})[{_U['gold']} % 5 + 1] AS gold,
        CASE WHEN {_U['hit']} % 10 < 7 THEN ({_ROUTES})[{_U['gold']} % 5 + 1] ELSE ({_ROUTES})[{_U['pred']} % 6 + 1] END AS pred,
        {_U['conf']} / 4294967296.0 AS conf FROM labels"""


def predictions(t):
    """Labels with a gold route (one class never occurs), a prediction and a confidence."""
    i = F.col("doc_id")
    gold = pick_from("gold", i, V.ROUTES[:5])
    pred = F.when(pick("hit", i, 10) < 7, gold).otherwise(pick_from("pred", i, V.ROUTES))
    return t.labels.select("doc_id", "quality", gold.alias("gold"), pred.alias("pred"), frac("conf", i).alias("conf"))


@query("confusion_matrix", f"SELECT gold, pred, count(*) AS n FROM ({PREDS_SQL}) GROUP BY ALL")
def _(t):
    return M.confusion(predictions(t))


PER_CLASS_SQL = f"""
    SELECT gold, count(*) AS n, round(avg((gold = pred)::INT), 6) AS accuracy,
        round(avg((gold = pred AND conf >= 0.6)::INT), 6) AS confident FROM ({PREDS_SQL}) GROUP BY gold"""


@query("per_class_accuracy", PER_CLASS_SQL)
def _(t):
    return M.per_class(predictions(t)).select("gold", "n", F.round("accuracy", 6).alias("accuracy"),
                                              F.round("confident", 6).alias("confident"))


@query("macro_accuracy", f"""
    SELECT round(avg(a), 6) AS macro, count(*) AS classes FROM (SELECT avg((gold = pred)::INT) AS a FROM ({PREDS_SQL}) GROUP BY gold)""")
def _(t):
    return M.macro_accuracy(predictions(t)).select(F.round("macro", 6).alias("macro"), "classes")


@query("default_class_leakage", f"""
    SELECT count(*) AS n, round(avg((pred <> 'chat' AND conf >= 0.6)::INT), 6) AS leakage FROM ({PREDS_SQL}) WHERE gold = 'chat'""")
def _(t):
    return M.leakage(predictions(t)).select("n", F.round("leakage", 6).alias("leakage"))


@query("micro_accuracy", f"""
    SELECT round(sum((gold = pred)::INT) / greatest(count(*), 1), 6) AS all_rows,
        round(sum((gold = pred AND conf >= 0.5)::INT) / greatest(count(*) FILTER (WHERE conf >= 0.5), 1), 6) AS labelled,
        round(sum((gold = pred AND conf > 2)::INT) / greatest(count(*) FILTER (WHERE conf > 2), 1), 6) AS none
    FROM ({PREDS_SQL})""")
def _(t):
    hit = F.col("gold") == F.col("pred")
    return predictions(t).agg(
        F.round(M.micro_accuracy(hit), 6).alias("all_rows"),
        F.round(M.micro_accuracy(hit, F.col("conf") >= 0.5), 6).alias("labelled"),
        F.round(M.micro_accuracy(hit, F.col("conf") > 2), 6).alias("none"))


@query("mean_loss_perplexity", """
    WITH w AS (SELECT lang, doc_id, unnest(string_split(text, ' ')) AS token FROM documents),
    c AS (SELECT token, count(*) AS n FROM w GROUP BY token), total AS (SELECT count(*) AS n FROM w),
    l AS (SELECT lang, -ln(c.n / (SELECT n FROM total)) AS nll, lang <> 'es' AND length(token) >= 5 AS supervised
          FROM w JOIN c USING (token))
    SELECT lang, count(*) FILTER (WHERE supervised) AS supervised, round(avg(nll) FILTER (WHERE supervised), 6) AS loss,
        round(exp(avg(nll) FILTER (WHERE supervised)), 3) AS perplexity FROM l GROUP BY lang""")
def _(t):
    # Counts per (language, token) carry everything: no token is joined row by row.
    tokens = t.documents.select("lang", F.explode(F.split("text", " ")).alias("token"))
    by_lang = tokens.groupBy("lang", "token").agg(n_rows().alias("n"))
    totals = by_lang.groupBy("token").agg(F.sum("n").alias("all_n"))
    size = by_lang.select(F.sum("n").alias("n")).scalar()
    nll = -F.log(F.col("all_n") / size)
    supervised = (F.col("lang") != "es") & (F.length("token") >= 5)
    sums = by_lang.join(totals, "token").groupBy("lang").agg(
        F.sum(F.when(supervised, F.col("n")).otherwise(0)).alias("supervised"),
        F.sum(F.when(supervised, F.col("n") * nll)).alias("loss_sum"))
    loss, ppl = M.perplexity(F.col("loss_sum"), F.col("supervised"))
    return sums.select("lang", "supervised", F.round(loss, 6).alias("loss"), F.round(ppl, 3).alias("perplexity"))


@query("exact_match_rate", r"""
    WITH s AS (SELECT lang, CASE WHEN doc_id % 5 = 0 THEN text ELSE 'it is 1,' || (doc_id * 7) || '.50 in all' END AS gold,
                      CASE WHEN doc_id % 3 = 0 THEN '1' || (doc_id * 7) || '.5' WHEN doc_id % 3 = 1 THEN 'none' ELSE doc_id || ' clips' END AS answer
               FROM documents),
    n AS (SELECT lang, try_cast(regexp_extract(replace(gold, ',', ''), '-?\d+(?:\.\d+)?') AS DOUBLE) AS g,
                 try_cast(regexp_extract(replace(answer, ',', ''), '-?\d+(?:\.\d+)?') AS DOUBLE) AS a FROM s)
    SELECT lang, count(*) AS total, count(*) FILTER (WHERE abs(g - a) < 1e-6) AS hits,
        round(count(*) FILTER (WHERE abs(g - a) < 1e-6) / count(*), 6) AS rate FROM n WHERE g IS NOT NULL GROUP BY lang""")
def _(t):
    rows = t.documents.select("lang", X.numeric_equal(*gold_and_answer()).alias("equal")).where("equal IS NOT NULL")
    return rows.groupBy("lang").agg(n_rows().alias("total"), F.count_if(F.col("equal")).alias("hits"),
                                    F.round(M.share(F.col("equal")), 6).alias("rate"))


@query("latency_percentiles", """
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50,
        round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max,
        round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type""")
def _(t):
    out = M.latency_report(t.events, ["event_type"], "value")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")],
                      "max", F.round("std", 6).alias("std"))


_BUDGET_VALUES = ", ".join(f"('{n}', {b})" for n, b in V.BUDGETS_MS)


@query("budget_report", f"""
    WITH b(target, budget) AS (VALUES {_BUDGET_VALUES})
    SELECT event_type, target, budget::DOUBLE AS budget, max(value) < budget AS fits, round(budget::DOUBLE - max(value), 6) AS headroom,
        round(avg((value > budget::DOUBLE)::INT), 6) AS share_over FROM events, b GROUP BY event_type, target, budget""")
def _(t):
    out = M.budget_report(t.events, ["event_type"], "value")
    return out.select("event_type", "target", "budget", "fits", F.round("headroom", 6).alias("headroom"),
                      F.round("share_over", 6).alias("share_over"))


@query("episode_scores", """
    SELECT user_id, round(avg(k), 6) AS avg_score, max(k) AS max_score, min(k) AS min_score,
        round(1000.0 / greatest(avg(value), 1e-6), 6) AS moves_per_sec
    FROM (SELECT user_id, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY user_id""")
def _(t):
    rows = t.events.select("user_id", "value", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return rows.groupBy("user_id").agg(
        F.round(F.avg("k"), 6).alias("avg_score"), F.max("k").alias("max_score"), F.min("k").alias("min_score"),
        F.round(1000.0 / F.greatest(F.avg("value"), F.lit(1e-6)), 6).alias("moves_per_sec"))


@query("follow_rate", """
    WITH p AS (SELECT l_returnflag AS f, (l_quantity::BIGINT % 10) AS r, l_partkey % 10 AS c, l_linenumber % 5 AS move,
        l_orderkey % 4 AS wanted, CASE l_returnflag WHEN 'A' THEN (l_suppkey % 2) * 9 ELSE l_suppkey % 10 END AS tr,
        CASE l_returnflag WHEN 'A' THEN (l_orderkey % 2) * 9 ELSE l_orderkey % 10 END AS tc FROM lineitem),
    m AS (SELECT *, least(greatest(r + CASE move WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END, 0), 9) AS nr,
        least(greatest(c + CASE move WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END, 0), 9) AS nc FROM p)
    SELECT CASE f WHEN 'R' THEN 'directional' WHEN 'A' THEN 'corner' ELSE 'target' END AS goal, count(*) AS trials,
        count(*) FILTER (WHERE CASE f WHEN 'R' THEN move = wanted ELSE abs(nr - tr) + abs(nc - tc) < abs(r - tr) + abs(c - tc) END) AS hits,
        round(avg((CASE f WHEN 'R' THEN move = wanted ELSE abs(nr - tr) + abs(nc - tc) < abs(r - tr) + abs(c - tc) END)::INT), 6) AS rate
    FROM m GROUP BY 1""")
def _(t):
    flag, corner = F.col("l_returnflag"), F.col("l_returnflag") == "A"
    rows = t.lineitem.select(
        flag.alias("f"), (F.col("l_quantity").cast("bigint") % 10).alias("r"), (F.col("l_partkey") % 10).alias("c"),
        (F.col("l_linenumber") % 5).alias("move"), (F.col("l_orderkey") % 4).alias("wanted"),
        F.when(corner, F.col("l_suppkey") % 2 * 9).otherwise(F.col("l_suppkey") % 10).alias("tr"),
        F.when(corner, F.col("l_orderkey") % 2 * 9).otherwise(F.col("l_orderkey") % 10).alias("tc"))

    def moved(at: str, back: int, on: int):
        step = F.when(F.col("move") == back, -1).when(F.col("move") == on, 1).otherwise(0)
        return F.least(F.greatest(F.col(at) + step, F.lit(0)), F.lit(9))

    def away(r, c):
        return F.abs(r - F.col("tr")) + F.abs(c - F.col("tc"))

    hit = F.when(F.col("f") == "R", F.col("move") == F.col("wanted")).otherwise(
        away(moved("r", 0, 1), moved("c", 2, 3)) < away(F.col("r"), F.col("c")))
    goal = F.when(F.col("f") == "R", "directional").when(F.col("f") == "A", "corner").otherwise("target")
    return rows.groupBy(goal.alias("goal")).agg(n_rows().alias("trials"), F.count_if(hit).alias("hits"),
                                                F.round(M.share(hit), 6).alias("rate"))


SESSION_SQL = """
    SELECT user_id, count(*) AS replies, sum(greatest(1, k))::BIGINT AS tokens, round(sum(value), 4) AS seconds,
        round(sum(greatest(1, k)) / greatest(sum(value), 1e-9), 4) AS tok_s, round(sum(value) / count(*) * 1000, 3) AS ms_per_reply,
        round(count(*) / greatest(sum(value), 1e-9), 6) AS replies_s
    FROM (SELECT user_id, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY user_id"""


def session_stats(rows):
    """Figures per user from (user_id, value seconds, k tokens)."""
    tokens, seconds = F.sum(F.greatest(F.lit(1), F.col("k"))), F.sum("value")
    return rows.groupBy("user_id").agg(
        n_rows().alias("replies"), tokens.alias("tokens"), F.round(seconds, 4).alias("seconds"),
        F.round(tokens / F.greatest(seconds, F.lit(1e-9)), 4).alias("tok_s"),
        F.round(seconds / n_rows() * 1000, 3).alias("ms_per_reply"),
        F.round(n_rows() / F.greatest(seconds, F.lit(1e-9)), 6).alias("replies_s"))


@query("session_stats", SESSION_SQL)
def _(t):
    return session_stats(t.events.select("user_id", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k")))


@query("training_budget", """
    WITH c AS (SELECT sum(len(string_split(text, ' ')))::BIGINT AS tokens FROM conversations)
    SELECT tokens, 600 * 32 * 256 AS seen, round(600 * 32 * 256 / greatest(tokens, 1), 6) AS epochs,
        round(600 * 32 * 256 / 13700000, 6) AS tokens_per_param FROM c""")
def _(t):
    tokens = t.conversations.agg(F.sum(F.size(F.split("text", " "))).alias("tokens"))
    return training_budget(tokens, steps=600, batch=32, block=256, params=13_700_000)


def training_budget(tokens, steps: int, batch: int, block: int, params: int):
    """Tokens seen, epochs and tokens per parameter of a schedule."""
    seen = steps * batch * block
    return tokens.select("tokens", F.lit(seen).alias("seen"),
                         F.round(F.lit(seen) / F.greatest("tokens", F.lit(1)), 6).alias("epochs"),
                         F.lit(round(seen / params, 6)).alias("tokens_per_param"))


@query("repetition_stats", f"""
    WITH w AS (SELECT doc_id, text AS x, string_split(text, ' ') AS w, string_split(text, chr(10)) AS l FROM documents),
    g AS (SELECT *, CASE WHEN len(w) >= 4 THEN list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1:i + 4], ' ')) ELSE [] END AS g FROM w)
    SELECT doc_id, round(CASE WHEN len(g) > 0 THEN 1 - len(list_distinct(g)) / len(g) ELSE 0 END, 6)::DOUBLE AS repeated_4grams,
        round(1 - len(list_distinct(l)) / len(l), 6) AS duplicate_lines, round({_SHORT_SQL}, 6)::DOUBLE AS short_names FROM g""")
def _(t):
    rows = t.documents.select("doc_id", "text", F.split("text", " ").alias("w"))
    shares = M.repetition(F.col("w"), F.col("text"))
    return rows.select("doc_id", *[F.round(c, 6).alias(n) for n, c in shares.items()])


@query("ext_histogram", "SELECT source AS ext, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, ext")
def _(t):
    return (t.documents.groupBy(F.col("source").alias("ext")).agg(n_rows().alias("n"))
            .orderBy(F.desc("n"), "ext"))
