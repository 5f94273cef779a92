"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of every source, its documents in a seeded order, form a stream that is cut into
blocks of equally many words. Seats of the mix, one block each, go to the source with the
highest quotient target / (2k - 1) for its k-th seat. Seats are dealt shard by shard: shard
j gets what the first j shards hold beyond the first j - 1, so that every shard has integer
quotas and every run of first shards is as close to the targets as whole blocks allow. A
source's seats are filled from its blocks in a seeded order: whole passes first, then a part.

Nothing but one row per source and shard is apportioned; a document computes the blocks it
lies in and their draws from its place in the stream, so blocks are never rows of a shuffle.

Defined cases: null texts and texts without words have size 0 and are taken 0 times; a null
source is a source of its own, the last one; repeated rows are documents of their own; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_of, store, words

# Primes for the seeded block order; the first that does not divide a source's number of
# blocks visits every block once.
PRIMES = (104395301, 122949823, 141650939, 160481183)


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)  # by source in order, repeating
    max_passes: int = 3                   # a source's target stops at this many times its size
    shards: int = 16
    block_words: int = 1024               # at most; small inputs use their 4096th part
    seed: int = 7


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """source, source_size -> with the target, in words, of each source.

    Shares go by weight. Sources are taken by the ratio at which they would reach their
    limit; those below the common level stop there and the rest share what is left.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, mix.weights)),
                   ((F.row_number().over(place) - 1) % len(mix.weights)).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumns({
        "limit": F.lit(mix.max_passes) * F.col("source_size")})
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rows = rows.withColumns({
        "total": F.sum("source_size").over(whole),
        "level": (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        / F.sum("weight").over(rest)})
    free = F.col("limit") >= F.col("level") * F.col("weight")
    rows = rows.withColumn("level", F.min(F.when(free, F.struct(
        F.col("limit") / F.col("weight"), F.col("level")))).over(whole)["level"])
    return rows.select("source", "source_size", "total", F.least(
        F.col("limit").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def block_size(total: Column, mix: Mix) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(mix.block_words), F.floor(total / 4096))).cast("bigint")


def shard_quotas(targets: DataFrame, mix: Mix) -> DataFrame:
    """source, shard, quota (blocks), source_blocks, block: integer quotas per shard.

    With h seats and S sources, a source's seats lie between those whose quotient exceeds
    2T / (2h - S) and those whose quotient exceeds 2T / (2h + S). Only the seats between,
    about two a source, are ranked.
    """
    rows = targets.withColumn("block", block_size(F.col("total"), mix)).withColumns({
        "source_blocks": F.ceil(F.col("source_size") / F.col("block")),
        "n_sources": F.count(F.lit(1)).over(Window.partitionBy())})
    rows = rows.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(mix.shards)))).withColumn(
        "h", F.round(F.col("total") * F.col("shard") / (F.col("block") * mix.shards)).cast("bigint"))
    most = F.lit(mix.max_passes) * F.col("source_blocks")

    def seats(n: Column) -> Column:
        return F.greatest(F.lit(0), F.least(most, F.floor((F.col("target") * n / F.col("total") + 1) / 2)))

    rows = rows.where("total > 0").withColumns({
        "low": seats(2 * F.col("h") - F.col("n_sources")),
        "high": seats(2 * F.col("h") + F.col("n_sources"))})
    by_shard = Window.partitionBy("shard")
    rows = rows.withColumn("open", F.col("h") - F.sum("low").over(by_shard))
    ranked = rows.where("high > low").withColumn("k", F.explode(F.sequence(F.col("low") + 1, F.col("high"))))
    order = by_shard.orderBy((F.col("target") / (2 * F.col("k") - 1)).desc(),
                             F.col("source").asc_nulls_last(), "k")
    won = (ranked.withColumn("at", F.row_number().over(order)).where("at <= open")
           .groupBy(key_of(F.col("source")).alias("key"), "shard").agg(F.count(F.lit(1)).alias("won")))
    held = rows.withColumn("key", key_of(F.col("source"))).join(won, ["key", "shard"], "left").withColumn(
        "seats", F.col("low") + F.coalesce("won", F.lit(0)))
    prior = Window.partitionBy("key").orderBy("shard")
    # Sources that reach their last block can make the later shards fall short of a seat.
    return held.select("key", "source", "shard", "source_blocks", "block", (
        F.greatest(F.lit(0), F.col("seats") - F.coalesce(F.lag("seats").over(prior), F.lit(0)))).alias("quota"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.size(words(F.col(text_col))).cast("bigint").alias("size"))


def placed(rows: DataFrame, mix: Mix) -> DataFrame:
    """`rows` (doc_id, source, size, ..) with source_size, target, start, block, draws.

    Word places come in two steps: inside buckets of rows, then over the buckets of a source;
    with n rows there are about sqrt(n) buckets, each holding rows of all sources alike.
    """
    n = rows.count()
    buckets = max(1, round(n ** 0.5))
    head = F.conv(F.substring(F.md5(F.concat(F.lit(f"{mix.seed}:"), key_of(F.col("doc_id")))), 1, 12), 16, 10)
    rows = rows.withColumns({"key": key_of(F.col("source")), "bucket": F.pmod(head.cast("bigint"), F.lit(buckets))})
    sums = store(rows.groupBy("source", "key", "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    targets = store(source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), mix),
                    "mix-targets")
    draws = shard_quotas(targets, mix).groupBy("key", "source_blocks", "block").agg(
        F.sum("quota").alias("draws"))
    about = targets.withColumn("key", key_of(F.col("source"))).drop("source").join(draws, "key", "left")
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    about = offsets.join(about, "key")  # one row per bucket and source
    # Sums and join want the same keys, so rows, which may carry their texts, are shuffled once.
    inside = (Window.partitionBy("bucket", "key").orderBy(F.col("doc_id").asc_nulls_last(), "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(about, ["bucket", "key"], "left")
            .withColumn("start", F.col("before") + F.col("_in")).drop("_in", "before", "bucket"))


def block_draws(k: Column, seed: int) -> Column:
    """How often block k of a source is drawn, from `draws` and `source_blocks`."""
    m = F.greatest(F.col("source_blocks"), F.lit(1))
    order = [PRIMES[(seed + i) % len(PRIMES)] for i in range(len(PRIMES))]
    step = F.coalesce(*[F.when(m % p != 0, F.lit(p)) for p in order], F.lit(1))
    at = (k * step + seed * 7919) % m
    return F.floor(F.col("draws") / m) + (at < F.col("draws") % m).cast("bigint")


def mix_words(docs: DataFrame, mix: Mix = Mix(), **columns: str) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken and copies.

    `taken` counts the words of the row inside drawn blocks, once per draw; `copies` is how
    often the block with the row's first word is drawn.
    """
    rows = placed(store(sized(docs, **columns), "mix-sizes"), mix)
    return rows.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"),
                       _taken(mix).alias("taken"), _copies(mix).alias("copies"))


def _taken(mix: Mix) -> Column:
    end, b = F.col("start") + F.col("size"), F.col("block")
    blocks = F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))
    return F.when((F.col("size") > 0) & F.col("draws").isNotNull(), F.aggregate(
        blocks, F.lit(0).cast("bigint"), lambda a, k: a + block_draws(k, mix.seed) * (
            F.least(end, (k + 1) * b) - F.greatest(F.col("start"), k * b)))).otherwise(F.lit(0)).cast("bigint")


def _copies(mix: Mix) -> Column:
    first = F.floor(F.col("start") / F.col("block"))
    return F.when((F.col("size") > 0) & F.col("draws").isNotNull(),
                  block_draws(first, mix.seed)).otherwise(F.lit(0)).cast("bigint")


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of `docs` as the mix takes them: whole, each as often as the block with its
    first word is drawn. Rows are repeated where a source weighs more than its share and left
    out where it weighs less."""
    kept = docs.columns
    rows = docs.withColumns({"_row": F.struct(*[F.col(f"`{c}`") for c in kept])}).select(
        "_row", "doc_id", F.col("source").cast("string").alias("source"),
        F.size(words(F.col("text"))).cast("bigint").alias("size"))
    drawn = placed(rows, mix).withColumn("_n", _copies(mix))
    return drawn.where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))
                                            ).select(*[F.col(f"_row.`{c}`").alias(c) for c in kept])
