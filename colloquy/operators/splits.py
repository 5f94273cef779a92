"""Train and validation sides, samples, caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import md5_order
from .scan import Digest, ranked


def every_nth_by_digest(keys: DataFrame, key: str, n: int) -> DataFrame:
    """Every n-th of the distinct keys in digest order: an exact share of a small set."""
    distinct = keys.select(key).distinct().withColumn("_digest", F.md5(F.col(key)))
    return ranked(distinct, [Digest("_digest")]).where((F.col("rn") - 1) % n == 0).select(key)


def count_rows(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery: one number, no join."""
    return df.select(F.count(F.lit(1))).scalar()


def prefix_split(df: DataFrame, order: Sequence[str], share: float = 0.9) -> DataFrame:
    """The first `share` of the rows, at least one, is training."""
    cut = F.greatest(F.lit(1), F.floor(count_rows(df) * F.lit(share)))
    return ranked(df, order).withColumn(
        "side", F.when(F.col("rn") <= cut, "train").otherwise("val")).drop("rn")


def shuffled_split(df: DataFrame, key: str, seed: str, n_val: dict[str, Column]) -> DataFrame:
    """One side column per entry: the first n_val rows of one shuffle are validation."""
    rows = ranked(df.withColumn("_digest", md5_order(seed, F.col(key))), [Digest("_digest")])
    return rows.withColumns({out: F.when(F.col("rn") <= n, "val").otherwise("train")
                             for out, n in n_val.items()}).drop("rn", "_digest")


def cap_per_group(df: DataFrame, order: Sequence[str], group: Sequence[str], cap: Column | int | None,
                  out: str = "rn", hot_rows: int | None = None) -> DataFrame:
    """The first `cap` rows of each group, numbered; without a cap, all of them."""
    rows = ranked(df, order, group, out, hot_rows)
    if cap is None:
        return rows
    return rows.where(F.col(out) <= (F.lit(cap) if isinstance(cap, int) else cap))


def first_of_copies(df: DataFrame, digest: Column, key: str) -> DataFrame:
    """Per digest the row with the smallest key.

    Winners are found by a partial aggregate over (digest, key) only, so a text that
    fills a third of the table is reduced before it is shuffled; whole rows then meet
    their own unique key. A null digest is nobody's copy, so such rows all stay.
    """
    digest = F.coalesce(digest, F.concat(F.lit("null "), F.col(key).cast("string")))
    first = df.groupBy(digest.alias("_digest")).agg(F.min(key).alias(key)).select(key)
    return df.join(first, key, "left_semi")


def interleave_order(rows: DataFrame, rn: str, weight: Column, place: Column) -> DataFrame:
    """Sort keys of a weighted round robin: round, place of the source, number in it."""
    return rows.withColumn("round", F.floor((F.col(rn) - 1) / weight)).withColumn("place", place)

