"""Scans, sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import predicates as P
from ..functions.hashing import held_out
from ..operators import traces
from ..operators import vocabulary as B
from ..operators.dialogues import dialogues, fragments, turns_of
from ..session import scratch_path
from ..sources import files, mix, shards, sinks
from .dialect import byte_sql, parts_sql, quote
from .on_extract import RENDERED_SQL, conversation_ids
from .on_filters import VERDICT_SQL, code_rows
from .on_text import recut
from .registry import query


@query("read_pruned", """
    SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn LIMIT 200""")
def _(t):
    return t.conversations.select("conv_id", "turn", "text").orderBy("conv_id", "turn").limit(200)


@query("turns_to_dialogues", f"""
    SELECT conv_id, part, count(*) AS n_turns, string_agg(role, ',' ORDER BY pos) AS roles,
        string_agg(text, chr(10) ORDER BY pos) AS dialogue FROM ({parts_sql('SELECT * FROM conversations')}) GROUP BY conv_id, part""")
def _(t):
    return fragments(t.conversations).select(
        "conv_id", "part", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join("turns.role", ",").alias("roles"), F.array_join("turns.text", "\n").alias("dialogue"))


@query("array_dialogues", f"""
    SELECT conv_id, part, count(*) AS n_turns, string_agg(role, ',' ORDER BY pos) AS roles,
        string_agg(text, chr(10) ORDER BY pos) AS dialogue
    FROM ({parts_sql('SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM conversations')})
    GROUP BY conv_id, part""")
def _(t):
    # A table that holds a dialogue as two array columns, as some sources do.
    whole = dialogues(t.conversations).select("conv_id", F.col("turns.text").alias("dialogue"), F.col("turns.role").alias("speakers"))
    return fragments(turns_of(whole, "conv_id", "dialogue", "speakers")).select(
        "conv_id", "part", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join("turns.role", ",").alias("roles"), F.array_join("turns.text", "\n").alias("dialogue"))


@query("read_chat_xml", """
    SELECT 'room' || conv_id % 16 AS session, conv_id * 1000000000 + turn AS pos,
        CASE WHEN role = 'system' THEN 'System' WHEN turn % 3 = 0 THEN 'Other' ELSE 'Statement' END AS act,
        CASE WHEN turn % 4 = 3 THEN '' ELSE regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') END AS text
    FROM conversations""")
def _(t):
    folder = scratch_path(t.spark, "xml")
    act = F.when(F.col("role") == "system", "System").when(F.col("turn") % 3 != 0, "Statement")
    posts = t.conversations.select(
        F.concat(F.lit("room"), (F.col("conv_id") % 16).cast("string")).alias("room"),
        act.alias("_class"), (F.col("conv_id") * 1_000_000_000 + F.col("turn")).alias("_pos"),
        F.when(F.col("turn") % 4 != 3, F.col("text")).alias("_VALUE"))
    (posts.write.partitionBy("room").format("xml").option("rowTag", "Post")
     .option("rootTag", "Session").save(folder))
    return files.read_chat_xml(t.spark, folder, F.col("room"))


_TREE_DIRS = ["py", "extmod", "node_modules", "shared", "docs"]


@query("scan_source_files", """
    SELECT doc_id, (['py','extmod','node_modules','shared','docs'])[doc_id % 5 + 1] AS dir, text AS content
    FROM documents WHERE doc_id % 5 IN (0, 1, 3)""")
def _(t):
    # Files of up to 50 documents below five folders; a mark starts each document.
    folder = scratch_path(t.spark, "tree")
    dirs = F.get(F.array(*[F.lit(d) for d in _TREE_DIRS]), (F.col("doc_id") % 5).cast("int"))
    (t.documents.select(dirs.alias("dir"), F.concat(F.lit("\x01"), F.col("doc_id").cast("string"),
                                                    F.lit("\n"), "text").alias("value"))
     .write.partitionBy("dir").option("maxRecordsPerFile", 50).text(folder))
    found = files.scan_source_files(
        t.spark, folder, subdirs=["dir=py", "dir=extmod", "dir=shared", "dir=node_modules"],
        skip_dirs=["dir=node_modules"], exts=["txt"], max_bytes=64 * 1024 * 1024)
    docs = found.select(F.regexp_extract("path", "^dir=([^/]+)/", 1).alias("dir"),
                        F.explode(F.split("text", "(^|\n)\x01")).alias("d")).where("d <> ''")
    return docs.select(F.substring_index("d", "\n", 1).cast("bigint").alias("doc_id"), "dir",
                       F.regexp_replace(F.regexp_replace("d", r"^\d+\n", ""), r"\n\z", "").alias("content"))


@query("read_nul_blob", """
    SELECT doc_id, 'lib/f' || doc_id || '.' || e AS path, CASE e WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' END AS lang, text
    FROM (SELECT *, (['py','c','go'])[doc_id % 3 + 1] AS e FROM documents)""")
def _(t):
    folder = scratch_path(t.spark, "blob")
    ext = F.get(F.array(F.lit("py"), F.lit("c"), F.lit("go")), (F.col("doc_id") % 3).cast("int"))
    chunk = F.concat(F.lit("lib/f"), F.col("doc_id").cast("string"), F.lit("."), ext, F.lit("\n"), "text")
    t.documents.select(chunk.alias("value")).write.option("lineSep", "\0").text(folder)
    return files.read_nul_blob(t.spark, folder).select(
        F.regexp_extract("path", r"f(\d+)\.", 1).cast("bigint").alias("doc_id"), "path", "lang", "text")


_MIX_VALUES = ", ".join(
    f"({quote(n)}, {quote(li)}, {cap}, {scan}, {w})" for n, _, li, cap, scan, w in V.SOURCE_MIX)
_NAMES = [s[0] for s in V.SOURCE_MIX]
_NAME_SQL = f"([{', '.join(quote(n) for n in _NAMES)}])[substr(source, 4)::INTEGER % {len(_NAMES)} + 1]"


@query("union_sources", f"""
    WITH r AS ({RENDERED_SQL}), m(name, licence, cap, scan, weight) AS (VALUES {_MIX_VALUES})
    SELECT doc_id, kind, question, answer, name, licence, weight::BIGINT AS weight
    FROM (SELECT *, {_NAME_SQL} AS name FROM r) JOIN m USING (name)""")
def _(t):
    rendered = traces.render_all(traces.raw_sources(recut(t.documents)))
    name = F.get(F.array(*[F.lit(n) for n in _NAMES]), F.substring("source", 4, 9).cast("int") % len(_NAMES))
    return (rendered.withColumn("name", name).join(mix.registry(t.spark), "name")
            .select("doc_id", "kind", "question", "answer", "name", "licence", "weight"))


@query("skip_bad_rows", """
    WITH s AS (SELECT event_id, event_type, CASE WHEN event_id % 11 = 0 THEN substr(props, 1, 4) ELSE props END AS p FROM events)
    SELECT event_type, count(*) AS n_rows, count(*) FILTER (WHERE json_valid(p)) AS kept,
        count(*) FILTER (WHERE NOT json_valid(p)) AS dropped,
        (sum(CASE WHEN json_valid(p) THEN json_extract_string(p, '$.k')::BIGINT END))::BIGINT AS k FROM s GROUP BY event_type""")
def _(t):
    damaged = F.when(F.col("event_id") % 11 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    parsed = t.events.select("event_type", F.from_json(
        damaged, "k bigint, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("p"))
    bad = F.col("p._corrupt_record").isNotNull()
    return parsed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~bad).alias("kept"), F.count_if(bad).alias("dropped"),
        F.sum(F.when(~bad, F.col("p.k"))).alias("k"))


@query("gather_sources", """
    SELECT source, n_rows, stage FROM (
        SELECT 'conversations' AS source, (SELECT count(*) FROM conversations) AS n_rows, NULL AS stage
        UNION ALL SELECT 'documents', (SELECT count(*) FROM documents), NULL
        UNION ALL SELECT 'missing', 0, 'open' UNION ALL SELECT 'damaged', 0, 'read'
        UNION ALL SELECT 'half damaged', 0, 'read')""")
def _(t):
    # Two good sources, a folder that is not there, and files that are not what they are named.
    bad = scratch_path(t.spark, "bad")
    schema = "id string, text string"
    t.conversations.limit(5).select("text").write.text(bad)
    half = scratch_path(t.spark, "half")
    t.conversations.select(F.col("conv_id").cast("string").alias("id"), "text").write.parquet(half)
    t.conversations.limit(5).select("text").write.mode("append").text(half)
    sources = {
        "conversations": lambda: t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text"),
        "documents": lambda: t.documents.select(F.col("doc_id").cast("string").alias("id"), "text"),
        "missing": lambda: t.spark.read.parquet(f"{bad}-none"),
        "damaged": lambda: t.spark.read.schema(schema).parquet(bad),
        "half damaged": lambda: t.spark.read.schema(schema).parquet(half)}
    rows, errors = mix.gather(t.spark, sources)
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    names = t.spark.createDataFrame([(n,) for n in sources], "source string")
    return names.join(counts, "source", "left").join(errors, "source", "left").select(
        "source", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "stage")


@query("assert_not_empty", """
    WITH names AS (SELECT DISTINCT source FROM documents),
    c AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'es' AND length(text) < 600 GROUP BY source)
    SELECT source, coalesce(n, 0) AS n, coalesce(n, 0) = 0 AS empty FROM names LEFT JOIN c USING (source)""")
def _(t):
    names = t.documents.select("source").distinct()
    rows = t.documents.where((F.col("lang") == "es") & (F.length("text") < 600))
    return mix.empty_sources(rows, names)


@query("fits_block_check", f"""
    WITH i AS (SELECT length(text) + 1 AS n FROM conversations)
    SELECT max(n) AS longest, max(n) <= 512 AS fits, {len(V.READER_CHARS)} + 1 AS marker, true AS ends_on_marker,
        true AS fits_16_bits FROM i""")
def _(t):
    marker = len(V.READER_CHARS) + 1
    ids = conversation_ids(t).select(F.concat("ids", F.array(F.lit(marker))).alias("ids"))
    seen = ids.agg(F.max(F.size("ids").cast("bigint")).alias("longest"),
                   F.min(F.element_at("ids", -1)).alias("marker"),
                   F.max(F.element_at("ids", -1)).alias("high"), F.max(F.array_max("ids")).alias("top"))
    return seen.select("longest", (F.col("longest") <= 512).alias("fits"), "marker",
                       ((F.col("marker") == marker) & (F.col("high") == marker)).alias("ends_on_marker"),
                       (F.col("top") < 65536).alias("fits_16_bits"))


@query("write_token_shards", f"""
    SELECT CASE WHEN {byte_sql('conv_id::VARCHAR')} % 6 = 0 THEN 'val' ELSE 'train' END AS split,
        count(*) AS docs, sum(length(text))::BIGINT AS chars, true AS counted FROM conversations GROUP BY 1""")
def _(t):
    # Ids of the learned vocabulary; what is read back is decoded, and counted as it was written.
    side = F.when(held_out(F.col("conv_id").cast("string"), V.ROUTE_HOLDOUT), "val").otherwise("train")
    merges = B.bpe_learn(t.conversations, "text")
    rows = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("key"), side.alias("split"), "text")
    path = scratch_path(t.spark, "shards")
    told = sinks.write_token_shards(B.bpe_encode(rows, ["key", "split"], B.special_pieces(F.col("text"), []), merges, []), path)
    back = t.spark.read.format(shards.FORMAT).load(path)
    found = back.groupBy("split").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.length(B.bpe_decode(F.col("ids"), merges, []))).alias("chars"),
        F.sum(F.size("ids")).alias("n"))
    return found.join(told, "split").select("split", "docs", "chars", (
        (F.col("n") == F.col("tokens")) & (F.col("docs") == F.col("written"))).alias("counted"))


@query("write_aligned_streams", f"""
    SELECT conv_id, turn, length(text) + 4 AS n_ids, length(text) + 4 - 3 AS supervised,
        CASE WHEN contains(text, '.') THEN length(text) - instr(reverse(text), '.') + 3 ELSE -1 END AS action_at
    FROM (SELECT conv_id, turn, text FROM conversations)""")
def _(t):
    start, end, action = 90, 91, V.READER_CHARS.index(".")
    prompt = F.array(*[F.lit(start)] * 3)
    ids, mask = sinks.aligned(prompt, F.col("ids"), end)
    rows = conversation_ids(t).select("conv_id", "turn", ids.alias("ids"), mask.alias("mask"))
    rows = rows.withColumn("action", sinks.action_targets(F.col("ids"), action, F.lit(7)))
    path = scratch_path(t.spark, "aligned")
    key = F.concat_ws("-", "conv_id", "turn")
    sinks.write_token_shards(rows.select(key.alias("key"), F.lit("all").alias("split"), "ids", "mask"), path)
    # Actions are wider than a mask and go in a stream of their own, as ids off by one.
    actions = F.transform("action", lambda a: a + 1)
    sinks.write_token_shards(rows.select(key.alias("key"), F.lit("all").alias("split"), actions.alias("ids")), f"{path}-actions")
    back = t.spark.read.format(shards.FORMAT).load(path).join(
        t.spark.read.format(shards.FORMAT).load(f"{path}-actions").select("key", F.col("ids").alias("action")), "key")
    ids = F.split("key", "-")
    return back.select(
        F.get(ids, 0).cast("bigint").alias("conv_id"), F.get(ids, 1).cast("bigint").alias("turn"), F.size("ids").alias("n_ids"),
        F.aggregate("mask", F.lit(0), lambda a, m: a + m).alias("supervised"),
        (F.array_position("action", 8) - 1).alias("action_at"))


@query("corpus_metadata", f"""
    SELECT CASE WHEN {byte_sql('text')} % 40 = 0 THEN 'val' ELSE 'train' END AS split, source,
        count(*) AS docs, sum(len(string_split(text, ' ')))::BIGINT AS tokens FROM documents GROUP BY ALL""")
def _(t):
    side = F.when(held_out(F.col("text"), V.REASON_HOLDOUT), "val").otherwise("train")
    meta = t.documents.select(side.alias("split"), "source", F.size(F.split("text", " ")).alias("n")).groupBy(
        "split", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))
    path = scratch_path(t.spark, "meta")
    meta.write.json(path)
    return t.spark.read.schema(meta.schema).json(path)


def _plain(limit: int):
    return lambda t: t.conversations.where(F.length("text") <= limit).select("conv_id", "turn", "text")


def _trimmed(limit: int):
    return lambda t: t.conversations.where(F.length("text") <= limit).select("conv_id", "turn", F.trim("text").alias("text"))


@query("config_keyed_output", """
    SELECT step, reused, n_docs FROM (VALUES ('first', false), ('again', true), ('other limit', false),
            ('other renderer', false), ('other vocabulary', false), ('first once more', true)) v(step, reused),
        LATERAL (SELECT count(*) AS n_docs FROM conversations
            WHERE length(text) <= CASE WHEN step = 'other limit' THEN 200 ELSE 320 END)""")
def _(t):
    # The configuration is the same but for its name; plan, code and vocabulary tell outputs apart.
    root = scratch_path(t.spark, "keyed")
    steps = [("first", _plain(320), ()), ("again", _plain(320), ()), ("other limit", _plain(200), ()),
             ("other renderer", _trimmed(320), ()), ("other vocabulary", _plain(320), [("61", "62")]), ("first once more", _plain(320), ())]
    rows = []
    for step, make, vocabulary in steps:
        path, reused = sinks.keyed_output(t.spark, root, {"table": "conversations"}, lambda m=make: m(t), vocabulary=vocabulary)
        rows.append(t.spark.read.parquet(f"{path}/data").agg(F.count(F.lit(1)).alias("n_docs")).select(
            F.lit(step).alias("step"), F.lit(reused).alias("reused"), "n_docs"))
    return reduce(DataFrame.unionByName, rows)


_BUDGET = 20_000


@query("token_budget_cut", f"""
    WITH n AS (SELECT doc_id, len(string_split(text, ' '))::BIGINT AS n_tokens FROM documents),
    r AS (SELECT doc_id, n_tokens, coalesce(sum(n_tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM n)
    SELECT doc_id, n_tokens, before FROM r WHERE before < {_BUDGET}""")
def _(t):
    from ..operators.packing import token_budget
    docs = t.documents.select("doc_id", F.size(F.split("text", " ")).cast("bigint").alias("n_tokens"))
    return token_budget(docs, ["doc_id"], "n_tokens", _BUDGET)


@query("write_kept_files", f"""
    SELECT ext, count(*) AS n_files, sum(length(path) + 1 + length(x))::BIGINT AS n_chars
    FROM (SELECT *, 'src/' || doc_id || '.' || ext AS path FROM ({VERDICT_SQL}) WHERE reason IS NULL) GROUP BY ext""")
def _(t):
    rows = code_rows(t)
    kept = rows.where(P.file_verdict(F.col("ext"), F.col("x")).isNull())
    path = F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit("."), "ext")
    where = scratch_path(t.spark, "kept")
    kept.select("ext", F.concat_ws("\n", path, "x").alias("body")).write.partitionBy("ext").parquet(where)
    return (t.spark.read.parquet(where).groupBy("ext")
            .agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.length("body")).cast("bigint").alias("n_chars"))
            .orderBy(F.desc("n_files"), "ext"))
