"""Token ids into fixed blocks, document numbers and loss masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running


def token_budget(docs: DataFrame, order: Sequence[str], n_tokens: str, budget: int) -> DataFrame:
    """Documents in order until the budget is reached; the one that reaches it is kept.

    Adds `before`, the tokens written before the document.
    """
    rows = running(docs, order, (), {"before": ("sum", F.col(n_tokens))}, inclusive=False)
    return rows.where(F.col("before") < budget)


def pack_blocks(docs: DataFrame, order: Sequence[str], ids: str, end_id: int, block: int,
                group: Sequence[str] = (), ends: Column | None = None) -> DataFrame:
    """(group, block_no, ids) full blocks of the documents joined with an end id.

    Offsets are a running sum, so every token knows its block without any task holding
    the stream. A document is cut where it crosses a border and only its pieces move;
    a block collects at most `block` tokens. The incomplete last block is dropped. Rows may be
    parts of documents; `ends` then says which one ends its document.
    """
    end = F.array(F.lit(end_id))
    end = end if ends is None else F.when(ends, end).otherwise(F.array().cast("array<int>"))
    closed = docs.withColumn("_ids", F.concat(F.col(ids), end))
    if ends is not None:  # a part may be empty
        closed = closed.where(F.size("_ids") > 0)
    placed = running(closed, order, group, {"_at": ("sum", F.size("_ids").cast("bigint"))}, inclusive=False)
    first = F.floor(F.col("_at") / block)
    last = F.floor((F.col("_at") + F.size("_ids") - 1) / block)
    pieces = placed.withColumn("block_no", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("block_no") * block - F.col("_at"), F.lit(0))
    stop = F.least((F.col("block_no") + 1) * block - F.col("_at"), F.size("_ids").cast("bigint"))
    pieces = pieces.select(*group, "block_no", (F.col("_at") + start).alias("_from"), F.slice(
        "_ids", (start + 1).cast("int"), (stop - start).cast("int")).alias("_part"))
    blocks = pieces.groupBy(*group, "block_no").agg(
        F.array_sort(F.collect_list(F.struct("_from", "_part"))).alias("_parts"))
    return (blocks.select(*group, "block_no", F.flatten("_parts._part").alias("ids"))
            .where(F.size("ids") == block))


def next_tokens(ids: Column) -> Column:
    """Target at i is the id at i+1; the last one has none."""
    return F.concat(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))),
                    F.array_repeat(F.lit(None).cast("int"), F.least(F.size(ids), F.lit(1))))


def doc_numbers(ids: Column, sep: int) -> Column:
    """Document number of each token of a crop; a separator belongs to the one it closes."""
    def step(acc: Column, token: Column) -> Column:
        return F.struct(
            F.concat(acc["out"], F.array(acc["doc"])).alias("out"),
            (acc["doc"] + F.when(token == sep, 1).otherwise(0)).alias("doc"))

    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("doc"))
    return F.aggregate(ids, start, step)["out"]


def boundary_targets(ids: Column, docs: Column, ignore: int | None = None) -> Column:
    """Next-token targets, ignored where the next token is in another document."""
    hidden = F.lit(ignore).cast("int")
    return F.transform(ids, lambda _, i: F.when(
        F.get(docs, i + 1) == F.get(docs, i), F.get(ids, i + 1)).otherwise(hidden))


def answer_targets(ids: Column, start: Column, ignore: int | None = None) -> Column:
    """Next-token targets from the position before `start` on, ignored elsewhere."""
    hidden = F.lit(ignore).cast("int")
    n, first = F.size(ids), F.greatest(start, F.lit(1))
    return F.when(first >= n, F.array_repeat(hidden, n)).otherwise(F.concat(
        F.array_repeat(hidden, first - 1), F.slice(ids, first + 1, n - first), F.array(hidden)))
