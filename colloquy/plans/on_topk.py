"""Sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import md5_order
from ..operators import metrics as M
from ..operators import ranking as K
from ..operators.scan import Digest
from ..operators.splits import cap_per_group
from .dialect import md5_sql
from .on_aggregates import PREDS_SQL, predictions
from .registry import query


@query("limit_first_n", "SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT 60")
def _(t):
    return t.documents.select("doc_id", "source", "n_chars").orderBy("doc_id").limit(60)


_ITEMS_SQL = """SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS item, round(unnest(embedding)::DOUBLE, 2) AS score FROM embeddings"""


def vector_items(t):
    rows = t.embeddings.select("vec_id", F.posexplode("embedding").alias("item", "v"))
    return rows.select("vec_id", F.col("item").cast("bigint").alias("item"), F.round(F.col("v").cast("double"), 2).alias("score"))


@query("topk_filter", f"""
    SELECT vec_id, item, score FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY score DESC) AS r FROM ({_ITEMS_SQL})) WHERE r <= 8""")
def _(t):
    return K.topk_filter(vector_items(t), ["vec_id"], "score", 8).select("vec_id", "item", "score")


@query("nucleus_filter", """
    WITH c AS (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS item, count(*) AS n FROM events GROUP BY ALL),
    p AS (SELECT *, n / sum(n) OVER (PARTITION BY event_type) AS p FROM c),
    b AS (SELECT *, round(coalesce(sum(p) OVER (PARTITION BY event_type ORDER BY n DESC, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS before FROM p)
    SELECT event_type, item, n FROM b WHERE before <= 0.9""")
def _(t):
    counts = t.events.groupBy("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("item")).agg(
        F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("event_type").agg(F.sum("n").alias("total"))
    rows = counts.join(totals, "event_type").withColumn("p", F.col("n") / F.col("total"))
    return K.nucleus_filter(rows, ["event_type"], "item", "p", 0.9 + 1e-9).select("event_type", "item", "n")


@query("softmax_temperature", """
    WITH s AS (SELECT user_id, event_id, value / 0.7 AS s FROM events),
    m AS (SELECT *, exp(s - max(s) OVER (PARTITION BY user_id)) AS e FROM s)
    SELECT event_id, user_id, round(e / sum(e) OVER (PARTITION BY user_id), 6) AS p FROM m""")
def _(t):
    rows = t.events.select("event_id", "user_id", "value")
    return K.softmax(rows, ["user_id"], "value", 0.7).select("event_id", "user_id", F.round("p", 6).alias("p"))


@query("repetition_penalty", """
    WITH seen AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('click', 'error') AND user_id % 2 = 0)
    SELECT event_id, round(CASE WHEN seen.user_id IS NULL THEN s WHEN s > 0 THEN s / 1.15 ELSE s * 1.15 END, 6) AS score
    FROM (SELECT *, value - 8 AS s FROM events) e LEFT JOIN seen ON e.user_id = seen.user_id AND e.event_type = seen.event_type""")
def _(t):
    seen = (t.events.where("event_type IN ('click', 'error') AND user_id % 2 = 0")
            .select("user_id", "event_type").distinct().withColumn("seen", F.lit(True)))
    rows = t.events.select("event_id", "user_id", "event_type", (F.col("value") - 8).alias("s"))
    out = K.repetition_penalty(F.col("s"), F.coalesce("seen", F.lit(False)), 1.15)
    return rows.join(seen, ["user_id", "event_type"], "left").select("event_id", F.round(out, 6).alias("score"))


@query("legal_argmax", """
    WITH a AS (SELECT *, event_type IN ('view', 'click') AND user_id % 3 <> 0 AS allowed FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY allowed DESC, value DESC, event_id) AS rn FROM a)
    SELECT user_id, event_id, event_type, value, allowed FROM r WHERE rn = 1""")
def _(t):
    allowed = F.col("event_type").isin("view", "click") & (F.col("user_id") % 3 != 0)
    rows = t.events.select("user_id", "event_id", "event_type", "value", allowed.alias("allowed"))
    return K.legal_best(rows, ["user_id"], "value", "allowed", "event_id")


@query("top_confusions", f"""
    SELECT gold, pred, count(*) AS n FROM ({PREDS_SQL}) WHERE gold <> pred GROUP BY ALL ORDER BY n DESC, gold DESC, pred DESC LIMIT 5""")
def _(t):
    return M.top_confusions(M.confusion(predictions(t)))


@query("hash_shuffle", f"""
    SELECT doc_id, {md5_sql('shuffle', 'doc_id')} AS place FROM documents ORDER BY place""")
def _(t):
    return t.documents.select("doc_id", md5_order("shuffle", F.col("doc_id")).alias("place")).orderBy("place")


@query("balanced_sample", f"""
    SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {md5_sql('even', 'doc_id')}) AS rn FROM documents) WHERE rn <= 70""")
def _(t):
    rows = t.documents.select("doc_id", "lang", md5_order("even", F.col("doc_id")).alias("at"))
    return cap_per_group(rows, [Digest("at")], ["lang"], 70).select("doc_id", "lang")


@query("eval_subsample", f"SELECT doc_id, source FROM documents ORDER BY {md5_sql('eval', 'doc_id')} LIMIT 300")
def _(t):
    # Sort and limit together keep the best 300 of every task, no full sort.
    return (t.documents.select("doc_id", "source").orderBy(md5_order("eval", F.col("doc_id"))).limit(300))
