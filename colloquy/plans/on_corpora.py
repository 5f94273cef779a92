"""Whole corpora: the operators put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import render as R
from ..functions import text as T
from ..functions.hashing import held_out
from ..operators import dialogues as D
from ..operators import traces
from ..operators.scan import ranked
from ..operators.splits import cap_per_group, interleave_order
from ..operators.vocabulary import bpe_learn
from ..session import scratch_path, shared_dir
from ..sources.corpus import prepare_traces, trace_rows
from ..sources.mix import validation_cap
from ..sources.shards import FORMAT
from .dialect import S, byte_sql, clean_utterance_sql, squeeze_sql, strip_sql, sub_sql
from .on_extract import RENDERED_SQL, trailing_sql
from .on_text import recut
from .registry import query

LONG = 2000


@query("dialogue_corpus_stats", f"""
    WITH c AS (SELECT conv_id, turn, role, {clean_utterance_sql('text')} AS text FROM conversations WHERE role <> 'system'),
    k AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev,
              row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM c),
    d AS (SELECT conv_id, count(*) AS n_turns, bool_and(prev IS NULL OR prev <> role) AND count(DISTINCT role) = 2 AND bool_and(length(text) BETWEEN 1 AND {LONG}) AS alternates,
              string_agg((CASE WHEN i % 2 = 0 THEN 'A' ELSE 'B' END) || ': ' || text, chr(10) ORDER BY turn) || chr(10) || '{V.DIALOG_SEP}' || chr(10) AS doc
          FROM k GROUP BY conv_id HAVING count(*) >= 2)
    SELECT CASE WHEN {byte_sql('conv_id::VARCHAR')} % 6 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS docs, sum(n_turns)::BIGINT AS turns,
        sum(length(doc))::BIGINT AS chars, min(length(doc)) AS shortest, max(length(doc)) AS longest FROM d WHERE alternates GROUP BY 1""")
def _(t):
    # Cleaned once; what follows reads it several times. A dialogue with one empty or long
    # turn goes as a whole.
    shared_dir(t.spark)
    turns = t.conversations.where("role <> 'system'").select(
        "conv_id", "turn", "role", T.clean_utterance(F.col("text")).alias("text")).checkpoint()
    lines = D.rendered_lines(D.two_speaker_turns(turns, LONG))
    docs = lines.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("line")).alias("n"))
    side = F.when(held_out(F.col("conv_id").cast("string"), V.ROUTE_HOLDOUT), "val").otherwise("train")
    return docs.groupBy(side.alias("split")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n_turns").alias("turns"), F.sum("n").alias("chars"),
        F.min("n").alias("shortest"), F.max("n").alias("longest"))


KIND_WEIGHTS = {"expected_answer": 8, "hash_marks": 1, "rephrased": 3, "cot_only": 2, "qa": 3, "options": 2, "yes_no": 1}
TRACE_CAP, TRACE_VAL_LEAST = 60, 5
_KINDS = list(KIND_WEIGHTS)
_STEPS = strip_sql(r"array_to_string(list_transform(string_split(" + strip_sql("think") + r", chr(10)), lambda l: regexp_replace(l, '\s+$', '')), chr(10))")
_VALUE = strip_sql(f"regexp_extract(a, {S(V.TRAILING_VALUE)}, 1)")
_IDENTITY = sub_sql("lower(split_part(" + sub_sql("identity", r"(?i)\b(?:answer\s+choices|options)\b\s*:?", chr(1)) + ", chr(1), 1))", "[^a-z0-9]+")


def trace_sql(cap: int | None = None) -> str:
    capped = "" if cap is None else (
        f" WHERE rn <= CASE WHEN held_out THEN greatest({cap} // 40, {TRACE_VAL_LEAST}) ELSE {cap} END")
    return f"""
    WITH r AS ({RENDERED_SQL}),
    c AS (SELECT doc_id, kind, {squeeze_sql('question')} AS q, {_STEPS} AS steps, {squeeze_sql('answer')} AS a, {_IDENTITY} AS identity FROM r),
    d AS (SELECT doc_id, kind, q, {sub_sql(trailing_sql('steps'), chr(10) + '{3,}', chr(10) * 2)} AS t,
        CASE WHEN len(string_split(a, ' ')) <= 4 OR {_VALUE} = '' THEN a ELSE {_VALUE} END AS a, {byte_sql('identity')} % 40 = 0 AS held_out FROM c),
    f AS (SELECT *, row_number() OVER (PARTITION BY kind, held_out ORDER BY doc_id) AS rn FROM d
        WHERE length(q) BETWEEN 1 AND 600 AND length(t) >= 40 AND length(a) BETWEEN 1 AND 120 AND length(q) + length(t) + length(a) <= 1200),
    w(kind, place, weight) AS (VALUES {', '.join(f"('{k}', {i}, {w})" for i, (k, w) in enumerate(KIND_WEIGHTS.items()))})
    SELECT doc_id, kind, held_out, row_number() OVER (PARTITION BY held_out ORDER BY (rn - 1) // weight, place, rn) AS position,
        '{V.REASON} ' || q || chr(10) || '{V.THINK}' AS prompt, ' ' || t || chr(10) || '{V.ANSWER} ' || a AS target
    FROM f JOIN w USING (kind){capped}"""


def cleaned_traces(t):
    return traces.clean_traces(traces.render_all(traces.raw_sources(recut(t.documents))))


def trace_corpus(t, cap: int | None = None):
    """All kinds rendered, cleaned, split by identity and mixed by weight; with a cap, at most
    so many traces of each kind, and a share of it on the held-out side."""
    shared_dir(t.spark)
    rows = cleaned_traces(t).checkpoint()
    limit = None if cap is None else F.when(
        F.col("held_out"), validation_cap(F.lit(cap), V.REASON_HOLDOUT, TRACE_VAL_LEAST)).otherwise(cap)
    kept = cap_per_group(rows, ["doc_id"], ["kind", "held_out"], limit)
    order = F.array(*[F.lit(k) for k in _KINDS])
    weights = F.array(*[F.lit(w) for w in KIND_WEIGHTS.values()])
    place = F.array_position(order, F.col("kind")).cast("int") - 1
    mixed = interleave_order(kept, "rn", F.get(weights, place), place)
    return ranked(mixed, ["round", "place", "rn"], ["held_out"], "position").select(
        "doc_id", "kind", "held_out", "position", R.trace_prompt(F.col("question")).alias("prompt"),
        R.trace_target(F.col("think"), F.col("answer")).alias("target"))


@query("trace_corpus", trace_sql(TRACE_CAP))
def _(t):
    return trace_corpus(t, TRACE_CAP)


@query("trace_corpus_whole", trace_sql())
def _(t):
    return trace_corpus(t)


@query("trace_shards", f"""
    SELECT CASE WHEN held_out THEN 'val' ELSE 'train' END AS split, position, doc_id, prompt, target FROM ({trace_sql()})""")
def _(t):
    # Traces to ids of the learned vocabulary, written, and read back as text.
    merges = bpe_learn(t.conversations, "text")
    rows = trace_corpus(t)
    path, _ = prepare_traces(rows, merges, scratch_path(t.spark, "traces"), plan=cleaned_traces(t), required=())
    return trace_rows(t.spark.read.format(FORMAT).load(path), merges)
