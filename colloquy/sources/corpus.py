"""The job from traces to token shards: encoded, masked, cut at a budget, written and counted.

An output is named by everything that decides it: the plan of the traces with all their
renderers, the budgets, the end token and the vocabulary. A complete one is used again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators.scan import running
from ..operators.vocabulary import bpe_decode, bpe_encode, bpe_vocab, special_pieces
from ..session import scratch_path
from . import shards
from .fingerprint import fingerprint

TAGS = [V.REASON, V.THINK, V.ANSWER, V.END]
VAL_SHARE, VAL_LEAST = 50, 200_000


def supervised(traces: DataFrame, key: Sequence[str], merges: list[tuple[str, str]], special: list[str]) -> DataFrame:
    """(key, ids, mask) of rows with `prompt` and `target`: the target and the end are supervised."""
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("text")) for i, c in enumerate(("prompt", "target"))])
    texts = traces.select(*key, F.explode(sides).alias("s")).select(*key, "s.side", "s.text")
    ids = bpe_encode(texts, [*key, "side"], special_pieces(F.col("text"), special), merges, special)

    def of(side: int) -> Column:
        return F.first(F.when(F.col("side") == side, F.col("ids")), ignorenulls=True)
    end = F.array(F.lit(bpe_vocab(merges, special)[V.END]))
    both = ids.groupBy(*key).agg(of(0).alias("p"), of(1).alias("t"))
    mask = F.concat(F.array_repeat(F.lit(0), F.size("p")), F.array_repeat(F.lit(1), F.size("t") + 1))
    return both.select(*key, F.concat("p", "t", end).alias("ids"), mask.alias("mask"))


def budgets(tokens: int | None) -> tuple[int, int] | None:
    """Token budgets of the training and the held-out side."""
    return None if tokens is None else (tokens, max(tokens // VAL_SHARE, VAL_LEAST))


def prepare_traces(traces: DataFrame, merges: list[tuple[str, str]], root: str, tokens: int | None = None,
                   special: list[str] = TAGS, cached_only: bool = False, plan: DataFrame | None = None,
                   required: Sequence[str] = ("train", "val")) -> tuple[str, list[dict]]:
    """(path, metadata) of the shards of traces (doc_id, kind, held_out, position, prompt, target).

    Each side is taken in order of `position` until its budget is reached; the trace that reaches
    it is kept, and without a budget all are. Metadata are one entry per side with its traces,
    tokens and traces per kind; a kind that gave none counts 0. A `required` side without traces is
    an error, and nothing is left that could be taken for a finished output. `plan` names the output where
    the lineage of `traces` has been cut; it holds what was cut off.
    """
    spark = shards.register(traces.sparkSession)
    limits = budgets(tokens)
    path = f"{root.rstrip('/')}/{fingerprint({'budgets': limits, 'special': special}, plan or traces, vocabulary=merges)}"
    if (meta := shards.read_note(path)) is not None:
        return path, json.loads(meta)
    if cached_only:
        raise FileNotFoundError(f"no complete output at {path}")
    key = ["held_out", "position", "doc_id", "kind"]
    stored = scratch_path(spark, "trace-ids")
    supervised(traces, key, merges, special).write.parquet(stored)
    ids = spark.read.parquet(stored)
    if limits is not None:
        train, val = limits
        before = running(ids, ["position"], ["held_out"], {"before": ("sum", F.size("ids").cast("bigint"))}, inclusive=False)
        ids = before.where(F.col("before") < F.when(F.col("held_out"), val).otherwise(train))
    side = F.when(F.col("held_out"), "val").otherwise("train")
    name = F.concat_ws(":", "position", "doc_id", "kind")
    ordered = ids.repartitionByRange("held_out", "position").sortWithinPartitions("held_out", "position")
    ordered.select(name.alias("key"), side.alias("split"), "ids", "mask").write.format(shards.FORMAT).mode("overwrite").save(path)
    written = {s: {"split": s, "docs": d, "tokens": n, "supervised": m} for s, d, n, m in shards.written_counts(path)}
    if missing := [s for s in required if s not in written]:
        raise RuntimeError(f"no traces for {', '.join(missing)}; the output is not complete")
    kinds = [r["kind"] for r in traces.select("kind").distinct().collect()]  # as many as there are renderers
    back = spark.read.format(shards.FORMAT).load(path).select("split", F.element_at(F.split("key", ":"), -1).alias("kind"))
    kept = {(r["split"], r["kind"]): r["count"] for r in back.groupBy("split", "kind").count().collect()}
    meta = [{**written[s], "kinds": {k: kept.get((s, k), 0) for k in sorted(kinds)}} for s in ("train", "val") if s in written]
    shards.write_note(path, json.dumps(meta))  # last: an output without it is not complete
    return path, meta


def trace_rows(shards_read: DataFrame, merges: list[tuple[str, str]], special: list[str] = TAGS) -> DataFrame:
    """(split, position, doc_id, prompt, target) of shards as read, ids turned to text again."""
    parts = F.split("key", ":")
    start = F.array_position("mask", F.lit(1).cast("tinyint")).cast("int")
    prompt = F.slice("ids", F.lit(1), start - 1)
    target = F.slice("ids", start, F.size("ids") - start)
    return shards_read.select("split", F.get(parts, 0).cast("bigint").alias("position"), F.get(parts, 1).cast("bigint").alias("doc_id"),
                       bpe_decode(prompt, merges, special).alias("prompt"), bpe_decode(target, merges, special).alias("target"))
