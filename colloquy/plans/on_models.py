"""Models over tables, user functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import predicates as P
from ..functions.hashing import held_out, pick
from ..operators import metrics as E
from ..operators import models as M
from ..operators import ranking
from ..operators import traces
from ..operators.joins import fixed_table
from ..operators.rounds import classify_rows, train_in_rounds
from ..operators.scan import sliding
from .dialect import byte_sql, quote, u32_sql
from .on_aggregates import PREDS_SQL, predictions
from .on_extract import RENDERED_SQL
from .on_filters import _BLOCK_SQL, CASCADE_SQL, CUE_SQL, cue_rows, trigger_sql
from .dialect import word_sql
from .on_text import recut
from .registry import query

LANGS = ["de", "en", "es", "fr"]
WORDS_SQL = r"list_filter(string_split_regex(lower({x}), '\s+'), lambda w: w <> '')"
_HELD = f"{byte_sql('doc_id::VARCHAR')} % 6 = 0"
NB_SQL = f"""
    w AS (SELECT doc_id, lang, {_HELD} AS held, unnest({WORDS_SQL.format(x='text')}) AS w FROM documents),
    c AS (SELECT lang, w, count(*) AS n FROM w WHERE NOT held GROUP BY ALL),
    v AS (SELECT count(DISTINCT w) AS v FROM c), tot AS (SELECT lang, sum(n) AS t FROM c GROUP BY lang),
    prior AS (SELECT lang, ln(count(*) / sum(count(*)) OVER ()) AS lp FROM documents WHERE NOT ({_HELD}) GROUP BY lang),
    d AS (SELECT doc_id, w, count(*) AS n FROM w WHERE held AND w IN (SELECT w FROM c) GROUP BY ALL),
    a AS (SELECT doc_id FROM documents WHERE {_HELD}),
    s AS (SELECT a.doc_id, tot.lang, coalesce(sum(d.n * ln((coalesce(c.n, 0) + 1) / (tot.t + v.v))), 0) + any_value(prior.lp) AS s
          FROM a CROSS JOIN v CROSS JOIN tot JOIN prior ON prior.lang = tot.lang LEFT JOIN d ON d.doc_id = a.doc_id
          LEFT JOIN c ON c.w = d.w AND c.lang = tot.lang GROUP BY a.doc_id, tot.lang)"""


def bayes(t):
    docs = t.documents.select("doc_id", "lang", "text")
    held = held_out(F.col("doc_id").cast("string"), V.ROUTE_HOLDOUT)
    scores = M.naive_bayes_scores(docs.where(~held), docs.where(held), "doc_id", "lang",
                                  M.words(F.col("text")), LANGS)
    return M.class_distribution(scores, LANGS)


@query("naive_bayes_counts", f"""
    WITH {NB_SQL}
    SELECT doc_id, lang AS pred, round(s, 4) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS rn FROM s) WHERE rn = 1""")
def _(t):
    return bayes(t).select("doc_id", "pred", F.round(F.greatest(*[f"s_{c}" for c in LANGS]), 4).alias("score"))


@query("class_scores", f"""
    WITH {NB_SQL},
    e AS (SELECT doc_id, lang, exp(s - max(s) OVER (PARTITION BY doc_id)) AS e FROM s),
    p AS (SELECT doc_id, lang, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM e)
    SELECT doc_id, {', '.join(f"round(max(p) FILTER (WHERE lang = '{c}'), 6) AS p_{c}" for c in LANGS)} FROM p GROUP BY doc_id""")
def _(t):
    return bayes(t).select("doc_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in LANGS])


@query("train_text_classifier")
def _(t):
    docs = t.documents.select("doc_id", "lang", "text")
    held = held_out(F.col("doc_id").cast("string"), V.ROUTE_HOLDOUT)
    # Rounds are chosen among on one part of the held-out side and reported on the other.
    choose = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    tokens = M.words(F.col("text"))
    model = train_in_rounds(docs.where(~held), docs.where(held & choose), tokens, "lang")
    return E.per_class(classify_rows(model, docs.where(held & ~choose), "doc_id", tokens, "lang"))


@query("threshold_pick", f"""
    SELECT doc_id, CASE WHEN conf >= 0.6 THEN pred ELSE 'chat' END AS label, round(conf, 9) AS conf FROM ({PREDS_SQL})""")
def _(t):
    return predictions(t).select("doc_id", M.threshold_pick(F.col("pred"), F.col("conf")).alias("label"),
                                 F.round("conf", 9).alias("conf"))


# ------------------------------------------------------------ reply likelihood
MIX, ROOM = 0.4, 64
_PAIRS_SQL = f"""
    SELECT conv_id, turn, role, {WORDS_SQL.format(x='text')} AS reply,
        coalesce(lag({WORDS_SQL.format(x='text')}) OVER (PARTITION BY conv_id ORDER BY turn), []) AS ctx,
        coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS ctx_text, text FROM conversations"""


def _lm_sql(rows: str, keys: str) -> str:
    """CTEs that end in `scored`(keys, logp) for `rows`(keys, ctx, reply)."""
    on = " AND ".join(f"r.{k} = x.{k}" for k in keys.split(", "))
    return f"""
    allw AS (SELECT unnest({WORDS_SQL.format(x='text')}) AS w FROM conversations),
    corpus AS (SELECT w, count(*) / (SELECT count(*) FROM allw) AS p_all FROM allw GROUP BY w),
    cut AS (SELECT {keys}, reply, CASE WHEN {ROOM} - len(reply) <= 0 THEN [] ELSE ctx[-({ROOM} - len(reply)):] END AS ctx FROM {rows}),
    uw AS (SELECT {keys}, ctx, unnest(reply) AS w FROM cut),
    lp AS (SELECT {', '.join('uw.' + k for k in keys.split(', '))}, ln({1 - MIX} * len(list_filter(ctx, lambda v: v = uw.w)) / greatest(len(ctx), 1) + {MIX} * coalesce(p_all, 1e-9)) AS l
           FROM uw LEFT JOIN corpus ON corpus.w = uw.w),
    mean AS (SELECT {keys}, avg(l) AS l FROM lp GROUP BY {keys}),
    scored AS (SELECT {', '.join('r.' + k for k in keys.split(', '))}, coalesce(x.l, '-Infinity'::DOUBLE) AS logp FROM {rows} r LEFT JOIN mean x ON {on})"""


def reply_pairs(t):
    """Turns with the words of the turn before as context."""
    rows = t.conversations.withColumn("reply", M.words(F.col("text")))
    rows = sliding(rows, ["turn"], ["conv_id"], 1, {
        "ctx": lambda frame: F.first("reply").over(frame(-1, -1)),
        "ctx_text": lambda frame: F.first("text").over(frame(-1, -1))})
    return rows.withColumns({"ctx": F.coalesce("ctx", F.array().cast("array<string>")),
                             "ctx_text": F.coalesce("ctx_text", F.lit(""))})


def corpus(t):
    return M.corpus_words(t.conversations, M.words(F.col("text")))


@query("lm_score", f"""
    WITH pairs AS ({_PAIRS_SQL}), base AS (SELECT conv_id, turn, ctx, CASE WHEN turn = 3 THEN [] ELSE reply END AS reply FROM pairs),
    {_lm_sql('base', 'conv_id, turn')}
    SELECT conv_id, turn, round(logp, 6) AS logp FROM scored""")
def _(t):
    rows = reply_pairs(t).withColumn("reply", F.when(
        F.col("turn") == 3, F.array().cast("array<string>")).otherwise(F.col("reply")))
    return M.lm_score(rows, ["conv_id", "turn"], "ctx", "reply", corpus(t)).select(
        "conv_id", "turn", F.round("logp", 6).alias("logp"))


_CANDIDATE_SQL = "array_to_string(reply[1 + k * 3:5 + k * 3], ' ')"
_ECHO = f"CASE WHEN k = 4 THEN lower(ctx_text) ELSE {_CANDIDATE_SQL} END"
_CANNED = "[" + ", ".join(quote(c) for c in V.CANNED_LINES) + "]"


@query("mmi_rerank", f"""
    WITH pairs AS ({_PAIRS_SQL}),
    cand AS (SELECT conv_id, turn, k, ctx, ctx_text, {_ECHO} AS text FROM pairs, range(5) r(k) WHERE role = 'assistant' AND turn % 7 <> 5),
    ok AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, text ORDER BY k) AS copy FROM cand
        WHERE regexp_matches(text, '[A-Za-z]') AND length(text) <= 200 AND lower(text) <> lower(ctx_text) AND NOT {word_sql('text', _BLOCK_SQL)}),
    base AS (SELECT conv_id, turn, k, text, ctx, {WORDS_SQL.format(x='text')} AS reply FROM ok WHERE copy = 1),
    {_lm_sql('base', 'conv_id, turn, k')},
    null0 AS (SELECT conv_id, turn, k, (SELECT avg(ln({MIX} * coalesce(c.p_all, 1e-9))) FROM (SELECT unnest(base.reply) AS w) z LEFT JOIN corpus c ON c.w = z.w) AS alone FROM base),
    best AS (SELECT base.conv_id, base.turn, text, round(logp - 0.7 * alone, 6) AS score,
        row_number() OVER (PARTITION BY base.conv_id, base.turn ORDER BY logp - 0.7 * alone DESC, base.k) AS rn
        FROM base JOIN scored USING (conv_id, turn, k) JOIN null0 USING (conv_id, turn, k)),
    asked AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant')
    SELECT a.conv_id, a.turn, coalesce(b.text, ({_CANNED})[{u32_sql('canned', "a.conv_id || '-' || a.turn")} % 3 + 1]) AS reply,
        coalesce(b.score, 0) AS score, b.text IS NULL AS canned
    FROM asked a LEFT JOIN best b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.rn = 1""")
def _(t):
    asked = reply_pairs(t).where("role = 'assistant'")
    # Candidates are cut from the turn itself, and one echoes the user; some turns get none.
    k = F.explode(F.when(F.col("turn") % 7 != 5, F.sequence(F.lit(0), F.lit(4)))).alias("k")
    offered = asked.select("conv_id", "turn", "ctx", "ctx_text", "reply", k)
    text = F.when(F.col("k") == 4, F.lower("ctx_text")).otherwise(F.array_join(
        F.slice("reply", F.col("k") * 3 + 1, F.lit(5)), " "))
    offered = offered.select("conv_id", "turn", "k", "ctx", "ctx_text", text.alias("text"))
    best = choose_reply(offered, ["conv_id", "turn"], corpus(t))
    key = F.concat_ws("-", "conv_id", "turn")
    canned = F.get(F.array(*[F.lit(c) for c in V.CANNED_LINES]), pick("canned", key, 3).cast("int"))
    return asked.select("conv_id", "turn").join(best, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("text", canned).alias("reply"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.col("text").isNull().alias("canned"))


def choose_reply(offered, message: list[str], corpus_table):
    """The best acceptable candidate per message by how much the context raises it."""
    ok = offered.where(P.acceptable_reply(F.col("text"), F.col("ctx_text")))
    first = ok.groupBy(*message, "text").agg(F.min("k").alias("k"), F.first("ctx").alias("ctx"))
    rows = first.withColumn("reply", M.words(F.col("text")))
    given = M.lm_score(rows, [*message, "k"], "ctx", "reply", corpus_table, "given", MIX, ROOM)
    # A text is scored alone once, however many messages it is offered for.
    texts = rows.select("text", "reply").distinct().withColumn("none", F.array().cast("array<string>"))
    alone = M.lm_score(texts, ["text"], "none", "reply", corpus_table, "alone", MIX, ROOM).select("text", "alone")
    scored = given.join(alone, "text").withColumn("score", M.mmi(F.col("given"), F.col("alone")))
    # Chosen on the exact score; equal texts have equal scores, so ties are real.
    return ranking.best_of(scored, message, "score", "k").select(*message, "text", F.round("score", 6).alias("score"))


_PROBE = ", ".join(f"({quote(m)}, {quote(g)})" for m, g in V.PROBE)
_P = trigger_sql("x")
_PROBE_ROUTE = (f"CASE WHEN {_P['image']} THEN 'vision' WHEN {_P['codegen']} THEN 'codegen' "
                f"WHEN {_P['reason']} THEN 'reason' WHEN {_P['code']} THEN 'code' ELSE 'chat' END")
CUE_GOLD = ["vision", "codegen", "reason", "code", "reason", "vision", "reason", "reason", "chat"]
_CUE_GOLD = "[" + ", ".join(quote(g) for g in CUE_GOLD) + "]"


@query("eval_two_sets", f"""
    WITH h AS (SELECT 'held-out' AS set, ({_CUE_GOLD})[{u32_sql('cue', 'doc_id')} % 9 + 1] AS gold, coalesce({CASCADE_SQL}, 'chat') AS pred FROM ({CUE_SQL})),
    p AS (SELECT 'probe' AS set, gold, {_PROBE_ROUTE} AS pred FROM (VALUES {_PROBE}) v(x, gold)),
    a AS (SELECT * FROM h UNION ALL SELECT * FROM p),
    c AS (SELECT set, gold, count(*) AS n, avg((gold = pred)::INT) AS acc, avg((pred <> 'chat')::INT) AS away FROM a GROUP BY ALL)
    SELECT set, sum(n)::BIGINT AS n, round(avg(acc), 6) AS macro, round(max(away) FILTER (WHERE gold = 'chat'), 6) AS leakage FROM c GROUP BY set""")
def _(t):
    gold = F.get(F.array(*[F.lit(g) for g in CUE_GOLD]), pick("cue", F.col("doc_id"), 9).cast("int"))
    route = F.coalesce(P.first_trigger(F.col("x")), F.lit("chat"))
    held = cue_rows(t).select(F.lit("held-out").alias("set"), gold.alias("gold"), route.alias("pred"))
    probe = fixed_table(t.spark, V.PROBE, "x string, gold string").select(
        F.lit("probe").alias("set"), "gold", route.alias("pred"))
    return two_set_report(held.unionByName(probe))


def two_set_report(rows):
    """The same scores for every set, side by side."""
    per = rows.groupBy("set", "gold").agg(
        F.count(F.lit(1)).alias("n"), E.share(F.col("gold") == F.col("pred")).alias("acc"),
        E.share(F.col("pred") != "chat").alias("away"))
    return per.groupBy("set").agg(F.sum("n").alias("n"), F.round(F.avg("acc"), 6).alias("macro"),
                                  F.round(F.max(F.when(F.col("gold") == "chat", F.col("away"))), 6).alias("leakage"))


# -------------------------------------------------------------- user functions
@query("renderer_registry", f"""
    SELECT kind, count(*) AS n, sum(length(question))::BIGINT AS q_chars, sum(length(answer))::BIGINT AS a_chars FROM ({RENDERED_SQL}) GROUP BY kind
    UNION ALL SELECT 'shouted', count(*), sum(length(string_split(text, chr(10))[1]) + 1)::BIGINT, count(*) FROM documents
        WHERE length(text) - length(replace(text, chr(10), '')) >= 2""")
def _(t):
    rows = recut(t.documents)
    known = traces.render_all(traces.raw_sources(rows))
    # A renderer of the user's own, for other fields.
    shouted = traces.Rendering(F.concat("question", F.lit("!")), F.col("steps"), F.lit("!"))
    own = traces.render(rows.withColumn("kind", F.lit("shouted")), shouted.struct()).select(*known.columns)
    return known.unionByName(own).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("question")).alias("q_chars"),
        F.sum(F.length("answer")).alias("a_chars"))


class OverlapScorer:
    """A small stand-in model: words of the context are likely."""

    def logprob(self, context: str, continuation: str) -> float:
        known = set(context.lower().split(" "))
        said = continuation.lower().split(" ")
        return sum(math.log((0.5 if w in known else 0.0) + 0.0005) for w in said) / len(said)


@query("scorer_udf", """
    WITH p AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS r, string_split(lower(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')), ' ') AS c FROM conversations)
    SELECT conv_id, turn, round(list_avg(list_transform(r, lambda w: ln(CASE WHEN list_contains(c, w) THEN 0.5 ELSE 0 END + 0.0005))), 6) AS logp FROM p""")
def _(t):
    score = M.scorer_udf(OverlapScorer)
    rows = sliding(t.conversations.select("conv_id", "turn", "text"), ["turn"], ["conv_id"], 1,
                   {"ctx": lambda frame: F.first("text").over(frame(-1, -1))})
    return rows.select("conv_id", "turn", F.round(score("ctx", "text"), 6).alias("logp"))
