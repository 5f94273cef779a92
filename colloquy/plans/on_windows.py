"""Window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import fixed_values as V
from ..functions import render as R
from ..functions.hashing import md5_order, u32
from ..functions.text import normalize_ws
from ..operators import packing as K
from ..operators import ranking
from ..operators.scan import Digest, moving_quantile, ranked, running, sliding
from ..operators.splits import cap_per_group, every_nth_by_digest, interleave_order
from ..sources.mix import validation_cap
from .dialect import md5_sql, squeeze_sql, u32_sql
from .on_extract import _CONV_IDS, _ids_sql, conversation_ids
from .on_text import FIELDS_SQL, STATE_SQL, event_fields
from .registry import query

SEP = V.READER_CHARS.index(".")
# A turn is cut into crops of 65 ids, each beginning with the last id of the one before, so
# that every id but the first is some crop's target; a full stop separates documents.
CROP = 65
CROP_SQL = f"""SELECT conv_id, turn, k::BIGINT AS crop, ids[k * {CROP - 1} + 1:k * {CROP - 1} + {CROP}] AS ids FROM (
    SELECT conv_id, turn, ids, unnest(range(0, greatest(1, (len(ids) + {CROP - 3}) // {CROP - 1}))) AS k FROM ({_CONV_IDS}))"""
LONG_CROP_SQL = f"SELECT conv_id, turn, crop, generate_subscripts(ids, 1) - 1 AS pos, unnest(ids) AS token FROM ({CROP_SQL})"


def crops(t):
    last = F.greatest(F.floor((F.size("ids") + CROP - 3) / (CROP - 1)), F.lit(1)) - 1
    rows = conversation_ids(t).withColumn("crop", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return rows.withColumn("ids", F.slice("ids", (F.col("crop") * (CROP - 1) + 1).cast("int"), F.lit(CROP)))


def long_form(df, *columns: str):
    """One row per position of parallel arrays."""
    zipped = df.select("conv_id", "turn", "crop", F.posexplode(F.arrays_zip(*columns)).alias("pos", "z"))
    return zipped.select("conv_id", "turn", "crop", "pos", *[F.col(f"z.{c}").alias(c) for c in columns])


@query("doc_ids_from_separator", f"""
    SELECT conv_id, turn, crop, pos::INTEGER AS pos, (sum((token = {SEP})::INT) OVER (PARTITION BY conv_id, turn, crop ORDER BY pos) - (token = {SEP})::INT)::INTEGER AS doc
    FROM ({LONG_CROP_SQL})""")
def _(t):
    # A crop is one row of bounded length, so no window and no shuffle is needed.
    return long_form(crops(t).withColumn("doc", K.doc_numbers(F.col("ids"), SEP)), "doc")


@query("next_token_target", f"""
    SELECT conv_id, turn, crop, pos::INTEGER AS pos, token::INTEGER AS token, (lead(token) OVER (PARTITION BY conv_id, turn, crop ORDER BY pos))::INTEGER AS target
    FROM ({LONG_CROP_SQL})""")
def _(t):
    return long_form(crops(t).withColumns({"token": F.col("ids"), "target": K.next_tokens(F.col("ids"))}),
                     "token", "target")


@query("boundary_loss_mask", f"""
    WITH d AS (SELECT *, sum((token = {SEP})::INT) OVER (PARTITION BY conv_id, turn, crop ORDER BY pos) - (token = {SEP})::INT AS doc FROM ({LONG_CROP_SQL})),
    n AS (SELECT *, lead(token) OVER w AS next, lead(doc) OVER w AS next_doc FROM d WINDOW w AS (PARTITION BY conv_id, turn, crop ORDER BY pos))
    SELECT conv_id, turn, crop, pos::INTEGER AS pos, (CASE WHEN next_doc = doc THEN next END)::INTEGER AS target FROM n""")
def _(t):
    rows = crops(t).withColumn("doc", K.doc_numbers(F.col("ids"), SEP))
    return long_form(rows.withColumn("target", K.boundary_targets(F.col("ids"), F.col("doc"))), "target")


@query("prompt_loss_mask", f"""
    SELECT conv_id, turn, length(text) + 1 + 4 AS n, repeat('0', 4) || repeat('1', length(text) + 1) AS mask,
        substr(repeat('0', 4) || repeat('1', length(text) + 1), 2) AS shifted FROM conversations""")
def _(t):
    from ..sources.sinks import aligned
    prompt = F.array(*[F.lit(0)] * 4)
    ids, mask = aligned(prompt, F.col("ids"), 99)
    rows = conversation_ids(t).select("conv_id", "turn", ids.alias("ids"), mask.alias("mask"))
    # The trainer predicts ids[1:] from ids[:-1], so it reads the mask one further.
    return rows.select("conv_id", "turn", F.size("ids").alias("n"), F.array_join("mask", "").alias("mask"),
                       F.array_join(F.slice("mask", F.lit(2), F.size("mask") - 1), "").alias("shifted"))


@query("answer_loss_mask", f"""
    WITH s AS ({STATE_SQL}),
    x AS (SELECT s.event_id, state || ' | q: whats the score | a: the score is ' || f.v || chr(10) AS body
          FROM s JOIN ({FIELDS_SQL}) f ON f.event_id = s.event_id AND f.k = 'score'),
    i AS (SELECT event_id, instr(body, '| a: ') + 4 AS start, {_ids_sql('body', V.READER_CHARS.index(' '))} AS ids FROM x)
    SELECT event_id, array_to_string(list_transform(ids, lambda v, p: CASE WHEN p - 1 >= start - 1 AND p < len(ids)
        THEN ids[p + 1] ELSE -100 END), ' ') AS target FROM i""")
def _(t):
    text = R.reader_text(R.render_state_block(F.col("fields"), F.col("event_id")),
                         F.lit("whats the score"),
                         F.concat(F.lit("the score is "), F.col("fields")["score"]))
    rows = event_fields(t.events).select("event_id", text.alias("text"))
    rows = rows.select("event_id", X.char_ids(F.col("text"), V.READER_CHARS, "space").alias("ids"),
                       R.answer_start(F.col("text")).alias("start"))
    target = K.answer_targets(F.col("ids"), F.col("start"), ignore=-100)
    return rows.select("event_id", F.array_join(target, " ").alias("target"))


BLOCK, END = 128, 99


def _packed_sql(order: str) -> str:
    return f"""
    WITH i AS (SELECT conv_id, turn, list_append(ids, {END}) AS ids FROM ({_CONV_IDS})),
    o AS (SELECT ids, (sum(len(ids)) OVER (ORDER BY {order}) - len(ids))::BIGINT AS start FROM i),
    u AS (SELECT start + generate_subscripts(ids, 1) - 1 AS pos, unnest(ids) AS token FROM o)
    SELECT (pos // {BLOCK})::BIGINT AS block_no, string_agg(token::VARCHAR, ' ' ORDER BY pos) AS ids FROM u
    GROUP BY 1 HAVING count(*) = {BLOCK}"""


@query("pack_blocks", _packed_sql("conv_id, turn"))
def _(t):
    blocks = K.pack_blocks(conversation_ids(t), ["conv_id", "turn"], "ids", END, BLOCK)
    return blocks.select("block_no", F.array_join("ids", " ").alias("ids"))


@query("pack_stream", _packed_sql(md5_sql("pack", "(conv_id || '-' || turn)")))
def _(t):
    docs = conversation_ids(t).withColumn("at", md5_order("pack", F.concat_ws("-", "conv_id", "turn")))
    blocks = K.pack_blocks(docs, [Digest("at")], "ids", END, BLOCK)
    return blocks.select("block_no", F.array_join("ids", " ").alias("ids"))


@query("cap_per_group", """
    WITH d AS (SELECT doc_id, lang, CASE WHEN doc_id % 6 = 0 THEN 'val' ELSE 'train' END AS side FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, side ORDER BY doc_id) AS rn FROM d)
    SELECT doc_id, lang, side, rn FROM r WHERE rn <= CASE WHEN side = 'train' THEN 90 ELSE greatest(90 // 6, 20) END""")
def _(t):
    side = F.when(F.col("doc_id") % 6 == 0, "val").otherwise("train")
    rows = t.documents.select("doc_id", "lang", side.alias("side"))
    cap = F.when(F.col("side") == "train", 90).otherwise(validation_cap(F.lit(90), 6, 20))
    return cap_per_group(rows, ["doc_id"], ["lang", "side"], cap)


@query("scan_then_cap", """
    WITH s AS (SELECT doc_id, source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seen FROM documents),
    k AS (SELECT doc_id, source, seen, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS kept FROM s WHERE seen <= 40 AND n BETWEEN 16 AND 1500)
    SELECT * FROM k WHERE kept <= 15""")
def _(t):
    rows = t.documents.select("doc_id", "source", F.length("text").alias("n"))
    seen = cap_per_group(rows, ["doc_id"], ["source"], 40, "seen").where(F.col("n").between(16, 1500))
    return cap_per_group(seen, ["doc_id"], ["source"], 15, "kept").select("doc_id", "source", "seen", "kept")


@query("every_nth_by_digest", """
    SELECT p_type FROM (SELECT p_type, row_number() OVER (ORDER BY md5(p_type)) AS rn
        FROM (SELECT DISTINCT p_type || ' ' || p_name AS p_type FROM part)) WHERE (rn - 1) % 6 = 0""")
def _(t):
    keys = t.part.select(F.concat_ws(" ", "p_type", "p_name").alias("p_type"))
    return every_nth_by_digest(keys, "p_type", V.ROUTE_HOLDOUT)


@query("weighted_interleave", """
    WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn,
        substr(source, 4)::INTEGER AS place, 1 + substr(source, 4)::INTEGER % 3 AS w FROM documents)
    SELECT doc_id, source, row_number() OVER (ORDER BY (rn - 1) // w, place, rn) AS position FROM r""")
def _(t):
    place = F.substring("source", 4, 9).cast("int")
    rows = t.documents.select("doc_id", "source")
    rows = interleave_order(ranked(rows, ["doc_id"], ["source"]), "rn", 1 + place % 3, place)
    return ranked(rows, ["round", "place", "rn"], (), "position").select("doc_id", "source", "position")


@query("history_window", f"""
    WITH h AS (SELECT conv_id, turn, list(nullif(x, '')) OVER w AS h FROM
        (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END AS raw, {squeeze_sql('raw')} AS x FROM conversations)
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT conv_id, turn, coalesce(array_to_string(list_filter(h, lambda v: v IS NOT NULL)[-8:], chr(10)), '') AS history FROM h""")
def _(t):
    line = normalize_ws(F.when(F.col("turn") % 5 == 4, " ").otherwise(F.col("text")))
    rows = t.conversations.select("conv_id", "turn", line.alias("line"))
    return last_lines(rows, 8).select("conv_id", "turn", F.array_join("history", "\n").alias("history"))


def last_lines(rows, n: int):
    """The last n non-empty lines before each turn.

    Empty lines take no place, so lines are numbered without them first.
    """
    spoken = F.col("line") != ""
    rows = running(rows, ["turn"], ["conv_id"], {"_k": ("sum", F.when(spoken, 1).otherwise(0))}, inclusive=False)
    lines = rows.where(spoken).select("conv_id", F.col("_k").alias("_at"), "line")
    # Each line is seen by the turns whose count of lines before lies 1..n above its number.
    offered = lines.withColumn("_k", F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(n)), lambda d: F.col("_at") + d)))
    seen = offered.groupBy("conv_id", "_k").agg(F.array_sort(F.collect_list(F.struct("_at", "line"))).alias("l"))
    return rows.join(seen, ["conv_id", "_k"], "left").withColumn(
        "history", F.coalesce(F.col("l.line"), F.array().cast("array<string>"))).drop("l", "_k")


@query("recent_suppression", """
    WITH r AS (SELECT conv_id, turn, lower(split_part(text, ' ', 1)) AS reply FROM conversations WHERE role = 'assistant'),
    h AS (SELECT *, list(reply) OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS l FROM r)
    SELECT conv_id, turn, reply, coalesce(list_contains(l, reply), false) AS repeats FROM h""")
def _(t):
    rows = t.conversations.where("role = 'assistant'").select(
        "conv_id", "turn", (F.col("conv_id") % 10).alias("room"), F.lower(F.substring_index("text", " ", 1)).alias("reply"))
    rows = sliding(rows, ["conv_id", "turn"], ["room"], 8,
                   {"recent": lambda frame: F.collect_list("reply").over(frame(-8, -1))})
    return rows.select("conv_id", "turn", "reply", F.array_contains("recent", F.col("reply")).alias("repeats"))


@query("rerank_argmax", f"""
    WITH c AS (SELECT conv_id, turn, k, {u32_sql('rank', "conv_id || '-' || turn || '-' || k")} % 5 AS score FROM conversations, range(6) r(k) WHERE role = 'assistant'),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, k) AS rn FROM c)
    SELECT conv_id, turn, k, score FROM r WHERE rn = 1""")
def _(t):
    rows = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("k"))
    rows = rows.withColumn("score", u32("rank", F.concat_ws("-", "conv_id", "turn", "k")) % 5)
    return ranking.best_of(rows, ["conv_id", "turn"], "score", "k")


@query("best_so_far", """
    WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS step, (sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 100 + sum(o_custkey)::DOUBLE / 2) / count(*) AS loss FROM orders GROUP BY 1)
    SELECT step, loss, min(loss) OVER (ORDER BY step) AS best,
        coalesce(loss < min(loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM m""")
def _(t):
    step = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    # The measure is a weighted sum of two losses; whole cents make the sums exact.
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).cast("double") / 100
    other = F.sum("o_custkey").cast("double") / 2
    rows = t.orders.groupBy(step.cast("bigint").alias("step")).agg(
        ((cents + other) / F.count(F.lit(1))).alias("loss"))
    rows = running(rows, ["step"], (), {"before": ("min", F.col("loss"))}, inclusive=False)
    return rows.select("step", "loss", F.least("loss", "before").alias("best"),
                       F.coalesce(F.col("loss") < F.col("before"), F.lit(True)).alias("improved"))


@query("rolling_p99", """
    WITH h AS (SELECT event_id, user_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS l FROM events)
    SELECT event_id, user_id, list_sort(l)[floor(len(l) * 0.99)::BIGINT + 1] AS p99 FROM h""")
def _(t):
    rows = t.events.select("event_id", "user_id", "ts", "value")
    return moving_quantile(rows, ["ts", "event_id"], ["user_id"], "value", 200, 0.99, "p99").select("event_id", "user_id", "p99")


@query("alternation_check", """
    WITH l AS (SELECT conv_id, coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn), false) AS same FROM conversations)
    SELECT conv_id, count(*) FILTER (WHERE same) AS repeats, NOT bool_or(same) AS alternates FROM l GROUP BY conv_id""")
def _(t):
    rows = sliding(t.conversations.select("conv_id", "turn", "role"), ["turn"], ["conv_id"], 1,
                   {"before": lambda frame: F.first("role").over(frame(-1, -1))})
    same = F.coalesce(F.col("role") == F.col("before"), F.lit(False))
    return rows.groupBy("conv_id").agg(F.count_if(same).alias("repeats"), (~F.bool_or(same)).alias("alternates"))
