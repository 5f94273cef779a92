"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.hashing import frac, held_out
from ..functions.text import normalize_ws
from ..operators.joins import fixed_table, spread_join
from ..operators.scan import running
from ..operators.splits import every_nth_by_digest
from ..operators.templates import expand
from ..session import scratch_path
from ..sources import shards, sinks
from .dialect import byte_sql, quote, squeeze_sql, u32_sql
from .on_extract import conversation_ids, _CONV_IDS
from .on_filters import CODE_ROWS_SQL, code_rows
from .registry import query

_EXT_VALUES = ", ".join(f"({quote(e)}, {quote(n)})" for e, n in V.EXT_LANGUAGE.items() if e != "go")


@query("lookup_join", f"""
    SELECT c.doc_id, c.ext, language, quality FROM ({CODE_ROWS_SQL}) c
    LEFT JOIN (VALUES {_EXT_VALUES}) e(ext, language) ON c.ext = e.ext LEFT JOIN labels USING (doc_id)""")
def _(t):
    names = fixed_table(t.spark, [(e, n) for e, n in V.EXT_LANGUAGE.items() if e != "go"],
                        "ext string, language string")
    # labels grows with the data; Spark measures it and picks the join.
    return (code_rows(t).select("doc_id", "ext").join(names, "ext", "left")
            .join(t.labels, "doc_id", "left").select("doc_id", "ext", "language", "quality"))


_TEMPLATES = V.VISION_TEMPLATES + V.CODE_TEMPLATES + ["{pic} or {it}", "no slot"]
_TPL_VALUES = ", ".join(f"({quote(x)})" for x in _TEMPLATES)


@query("expand_templates", f"""
    WITH x AS (SELECT p_partkey, template, p_name, w FROM part CROSS JOIN (VALUES {_TPL_VALUES}) v(template)
        CROSS JOIN (VALUES ('that'), ('the code')) s(w) WHERE contains(template, '{{it}}') OR w = 'that')
    SELECT p_partkey, template, replace(replace(template, '{{pic}}', p_name), '{{it}}', w) AS text FROM x""")
def _(t):
    values = {"pic": F.col("p_name"), "it": F.array(F.lit("that"), F.lit("the code"))}
    return expand(t.part.select("p_partkey", "p_name"), _TEMPLATES, values).select(
        "p_partkey", "template", "text")


NTH_SOURCE_SQL = """
    SELECT source FROM (SELECT source, row_number() OVER (ORDER BY md5(source)) AS rn
        FROM (SELECT DISTINCT source FROM documents)) WHERE (rn - 1) % 6 = 0"""


@query("holdout_semi_anti", f"""
    SELECT doc_id, source, CASE WHEN source IN ({NTH_SOURCE_SQL}) THEN 'val' ELSE 'train' END AS side FROM documents""")
def _(t):
    docs = t.documents.select("doc_id", "source")
    held = every_nth_by_digest(docs, "source", V.ROUTE_HOLDOUT).withColumn("held", F.lit(True))
    # One pass over the rows; sources are frequent, so rows are spread if they are too many to send.
    rows = spread_join(docs, held, ["source"], F.col("doc_id"))
    return rows.select("doc_id", "source", F.when(F.col("held"), "val").otherwise("train").alias("side"))


@query("split_leak_check", f"""
    WITH s AS (SELECT md5(text) AS digest, {byte_sql('doc_id::VARCHAR')} % 6 = 0 AS held FROM documents)
    SELECT a.digest, a.n AS n_train, b.n AS n_val FROM (SELECT digest, count(*) AS n FROM s WHERE NOT held GROUP BY 1) a
    JOIN (SELECT digest, count(*) AS n FROM s WHERE held GROUP BY 1) b USING (digest)""")
def _(t):
    # Splitting by id lets copies cross; both sides are counted per text in one pass.
    held = held_out(F.col("doc_id").cast("string"), V.ROUTE_HOLDOUT)
    return (t.documents.groupBy(F.md5("text").alias("digest"))
            .agg(F.count_if(~held).alias("n_train"), F.count_if(held).alias("n_val"))
            .where("n_train > 0 AND n_val > 0"))


@query("context_null_join", f"""
    WITH c AS (SELECT conv_id, turn, k, {u32_sql('cand', "conv_id || '-' || turn || '-' || k")} / 4294967296.0 AS ctx,
        {u32_sql('null', "md5(text || k)")} / 4294967296.0 AS alone FROM conversations, range(3) r(k) WHERE role = 'assistant')
    SELECT conv_id, turn, k, round(ctx - 0.7 * alone, 6) AS score FROM c""")
def _(t):
    said = t.conversations.where("role = 'assistant'").select(
        "conv_id", "turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("k"),
        F.md5(F.concat("text", F.col("k").cast("string"))).alias("candidate"))
    given = said.withColumn("ctx", frac("cand", F.concat_ws("-", "conv_id", "turn", "k")))
    # A candidate is scored alone once, however often it is offered.
    alone = said.select("candidate").distinct().withColumn("alone", frac("null", F.col("candidate")))
    return given.join(alone, "candidate").select(
        "conv_id", "turn", "k", F.round(F.col("ctx") - V.MMI_LAMBDA * F.col("alone"), 6).alias("score"))


@query("gold_pred_compare", f"""
    WITH g AS (SELECT doc_id, text AS gold FROM documents),
    p AS (SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN NULL ELSE {squeeze_sql('text')} END AS pred FROM documents)
    SELECT CASE WHEN g.doc_id IS NULL THEN 'only produced' WHEN p.doc_id IS NULL THEN 'only expected'
        WHEN gold IS NOT DISTINCT FROM pred THEN 'same' ELSE 'different' END AS outcome, count(*) AS n
    FROM g FULL JOIN p ON g.doc_id = p.doc_id GROUP BY 1""")
def _(t):
    gold = t.documents.select(F.col("doc_id").alias("g"), F.col("text").alias("gold"))
    pred = t.documents.select(F.col("doc_id").alias("p"), F.when(
        F.col("doc_id") % 23 != 0, normalize_ws(F.col("text"))).alias("pred"))
    outcome = (F.when(F.col("g").isNull(), "only produced").when(F.col("p").isNull(), "only expected")
               .when(F.col("gold").eqNullSafe(F.col("pred")), "same").otherwise("different"))
    return (gold.join(pred, F.col("g") == F.col("p"), "full_outer").groupBy(outcome.alias("outcome"))
            .agg(F.count(F.lit(1)).alias("n")))


ASOF_SQL = """
    WITH w AS (SELECT event_id, user_id, event_type,
        last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS seen_image,
        last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS seen_value
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, user_id, seen_image, seen_value FROM w WHERE event_type = 'click'"""


@query("asof_last_state", ASOF_SQL)
def _(t):
    kind = F.col("event_type")
    rows = running(t.events.select("event_id", "user_id", "ts", "event_type", "value"), ["ts", "event_id"], ["user_id"], {
        "seen_image": ("last", F.when(kind == "view", F.col("event_id"))),
        "seen_value": ("last", F.when(kind == "purchase", F.col("value")))}, inclusive=False)
    return rows.where("event_type = 'click'").select("event_id", "user_id", "seen_image", "seen_value")


@query("crop_windows", f"""
    WITH i AS (SELECT * FROM ({_CONV_IDS}) WHERE len(ids) > 65),
    s AS (SELECT conv_id, turn, k, ids, {u32_sql('crop', "conv_id || '-' || turn || '-' || k")} % (len(ids) - 64) AS start FROM i, range(2) r(k))
    SELECT conv_id, turn, k, start, array_to_string(ids[start + 1:start + 65], ' ') AS crop FROM s""")
def _(t):
    # The ids are written once; a crop then reads its own range of them.
    path = scratch_path(t.spark, "crops")
    sinks.write_token_shards(conversation_ids(t).select(
        F.concat_ws("-", "conv_id", "turn").alias("key"), F.lit("all").alias("split"), "ids"), path)
    crops = t.spark.read.format(shards.FORMAT).option("crop", 65).option("draws", 2).load(path)
    ids = F.split("key", "-")
    return crops.select(F.get(ids, 0).cast("bigint").alias("conv_id"), F.get(ids, 1).cast("bigint").alias("turn"),
                        "k", "start", F.array_join("ids", " ").alias("crop"))


@query("attach_labels", """
    SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(t):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").select(
        "doc_id", "source", "quality", "toxic")
