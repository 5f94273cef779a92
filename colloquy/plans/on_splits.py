"""Set operations and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import grids as G
from ..functions import render as R
from ..functions import text as T
from ..functions.hashing import held_out, pick
from ..operators.splits import count_rows, every_nth_by_digest, prefix_split, shuffled_split
from ..operators.templates import expand
from .dialect import byte_sql, injected, injected_sql, md5_sql, quote, sub_sql, u32_sql
from .on_text import CHAT_SQL, OPTIONS, tagged_chat
from .registry import query

_HELD_TEXT = f"({byte_sql('lower(trim(text))')} % 6 = 0)"


@query("union_corpora", f"""
    SELECT 'chat' AS corpus, CASE WHEN {byte_sql('conv_id::VARCHAR')} % 6 = 0 THEN 'val' ELSE 'train' END AS split, part, doc
    FROM ({CHAT_SQL})
    UNION ALL SELECT 'documents', 'train', 0::BIGINT, text FROM documents WHERE NOT {_HELD_TEXT}""")
def _(t):
    side = F.when(held_out(F.col("conv_id").cast("string"), V.ROUTE_HOLDOUT), "val").otherwise("train")
    chat = tagged_chat(t).select(F.lit("chat").alias("corpus"), side.alias("split"), "part", "doc")
    # Documents are used for training only.
    key = F.lower(F.trim("text"))
    docs = t.documents.where(~held_out(key, V.ROUTE_HOLDOUT)).select(
        F.lit("documents").alias("corpus"), F.lit("train").alias("split"), F.lit(0).cast("bigint").alias("part"), F.col("text").alias("doc"))
    return chat.unionByName(docs)


@query("hash_split", f"""
    SELECT doc_id, {byte_sql('text')} % 40 = 0 AS held_40, {byte_sql('lower(trim(text))')} % 6 = 0 AS held_6 FROM documents""")
def _(t):
    return t.documents.select("doc_id", held_out(F.col("text"), V.REASON_HOLDOUT).alias("held_40"),
                              held_out(F.lower(F.trim("text")), V.ROUTE_HOLDOUT).alias("held_6"))


@query("identity_split", f"""
    WITH s AS (SELECT doc_id, {injected_sql('opt', 'doc_id', 'text', OPTIONS)} AS x FROM documents),
    k AS (SELECT doc_id, {sub_sql("lower(split_part(" + sub_sql('x', r'(?i)\b(?:answer\s+choices|options)\b\s*:?', chr(1)) + ", chr(1), 1))", '[^a-z0-9]+')} AS identity FROM s)
    SELECT doc_id, CASE WHEN {byte_sql('identity')} % 40 = 0 THEN 'val' ELSE 'train' END AS side FROM k""")
def _(t):
    raw = injected("opt", F.col("doc_id"), F.col("text"), OPTIONS)
    side = F.when(held_out(T.identity_key(raw), V.REASON_HOLDOUT), "val").otherwise("train")
    return t.documents.select("doc_id", side.alias("side"))


_TEMPLATES = V.GAME_TEMPLATES
_TPL = ", ".join(f"({quote(x)})" for x in _TEMPLATES)


@query("skeleton_split", f"""
    WITH s AS (SELECT template, template || ' ' || p_name AS skeleton, p_partkey, replace(replace(replace(replace(template, '{{stat}}', p_type), '{{thing}}', p_type), '{{noun}}', p_type), '{{verb}}', p_type) AS text
        FROM part CROSS JOIN (VALUES {_TPL}) v(template)),
    h AS (SELECT skeleton FROM (SELECT skeleton, row_number() OVER (ORDER BY md5(skeleton)) AS rn FROM (SELECT DISTINCT skeleton FROM s)) WHERE (rn - 1) % 6 = 0)
    SELECT CASE WHEN skeleton IN (SELECT skeleton FROM h) THEN 'val' ELSE 'train' END AS side, count(*) AS n, count(DISTINCT skeleton) AS skeletons,
        count(DISTINCT text) AS texts FROM s GROUP BY 1""")
def _(t):
    # A skeleton is a template with its subject; the filled value does not count.
    rows = expand(t.part.select("p_partkey", "p_name", "p_type"), _TEMPLATES,
                  {slot: F.col("p_type") for slot in ("stat", "thing", "noun", "verb")})
    rows = rows.withColumn("skeleton", F.concat_ws(" ", "template", "p_name"))
    held = every_nth_by_digest(rows, "skeleton", V.ROUTE_HOLDOUT).withColumn("held", F.lit(True))
    out = rows.join(held, "skeleton", "left").withColumn("side", F.when(F.col("held"), "val").otherwise("train"))
    return out.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("skeleton").alias("skeletons"),
                                   F.countDistinct("text").alias("texts"))


@query("prefix_split", """
    WITH r AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations))
    SELECT conv_id, CASE WHEN rn <= greatest(1, floor(0.9 * n)) THEN 'train' ELSE 'val' END AS side FROM r""")
def _(t):
    return prefix_split(t.conversations.select("conv_id").distinct(), ["conv_id"], 0.9)


@query("shuffled_fraction_split", f"""
    WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {md5_sql('part', 'doc_id')}) AS rn, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN rn <= greatest(1, floor(0.08 * n)) THEN 'val' ELSE 'train' END AS side_8,
        CASE WHEN rn <= greatest(200, n // 20) THEN 'val' ELSE 'train' END AS side_20 FROM r""")
def _(t):
    ids = t.documents.select("doc_id")
    n = count_rows(ids)
    return shuffled_split(ids, "doc_id", "part", {
        "side_8": F.greatest(F.lit(1), F.floor(n * F.lit(0.08))), "side_20": F.greatest(F.lit(200), F.floor(n / 20))})


@query("distinct_candidates", """
    WITH c AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: lower(w)) AS l FROM conversations)
    SELECT conv_id, turn, array_to_string(list_filter(l, lambda w, i: list_position(l, w) = i), ' ') AS candidates FROM c""")
def _(t):
    words = F.split(F.lower("text"), " ")
    return t.conversations.select("conv_id", "turn", F.array_join(F.array_distinct(words), " ").alias("candidates"))


@query("split_disjoint", f"""
    WITH d AS (SELECT {byte_sql('text')} % 6 = 0 AS held, {byte_sql('doc_id::VARCHAR')} % 6 = 0 AS loose, text FROM documents),
    a AS (SELECT DISTINCT text FROM d WHERE loose), b AS (SELECT DISTINCT text FROM d WHERE NOT loose)
    SELECT (SELECT count(*) FROM (SELECT text FROM d WHERE held INTERSECT SELECT text FROM d WHERE NOT held)) AS shared_by_text,
        (SELECT count(*) FROM (SELECT text FROM a INTERSECT SELECT text FROM b)) AS shared_by_id,
        (SELECT count(*) FROM (SELECT text FROM a EXCEPT SELECT text FROM b)) AS only_val""")
def _(t):
    # Texts are compared by digest, counted once per side.
    digest = F.md5("text")
    loose = held_out(F.col("doc_id").cast("string"), V.ROUTE_HOLDOUT)
    tight = held_out(F.col("text"), V.ROUTE_HOLDOUT)
    per_text = t.documents.groupBy(digest.alias("d")).agg(
        F.bool_or(tight).alias("tv"), F.bool_or(~tight).alias("tt"),
        F.bool_or(loose).alias("lv"), F.bool_or(~loose).alias("lt"))
    return per_text.agg(F.count_if(F.expr("tv AND tt")).alias("shared_by_text"),
                        F.count_if(F.expr("lv AND lt")).alias("shared_by_id"),
                        F.count_if(F.expr("lv AND NOT lt")).alias("only_val"))


@query("augment_union", f"""
    WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor((v::DOUBLE + 1) * 127.5)::INTEGER) AS px FROM embeddings),
    u AS (SELECT vec_id, label, 'flip' AS kind, CASE WHEN {u32_sql('flip', 'vec_id')} % 2 = 0 THEN list_transform(px, lambda v: 255 - v) ELSE px END AS px FROM p WHERE label < 5
        UNION ALL SELECT vec_id, label, 'plain', px FROM p WHERE label >= 5
        UNION ALL SELECT vec_id, label, 'mirror', list_transform(range(64), lambda k: px[(k // 8) * 8 + 8 - k % 8]) FROM p WHERE label >= 5)
    SELECT vec_id, label, kind, array_to_string(px, ' ') AS px FROM u""")
def _(t):
    px = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("int"))
    rows = t.embeddings.select("vec_id", "label", px.alias("px"))
    flipped = F.when(pick("flip", F.col("vec_id"), 2) == 0, F.transform("px", lambda v: 255 - v)).otherwise(F.col("px"))
    # One pass: a row becomes the list of its variants.
    def variant(kind: str, value):
        return F.struct(F.lit(kind).alias("kind"), value.alias("px"))
    both = F.array(variant("plain", F.col("px")), variant("mirror", F.flatten(G.mirror(G.as_rows(F.col("px"), 8)))))
    variants = F.when(F.col("label") < 5, F.array(variant("flip", flipped))).otherwise(both)
    out = rows.select("vec_id", "label", F.explode(variants).alias("v"))
    return out.select("vec_id", "label", "v.kind", F.array_join("v.px", " ").alias("px"))
