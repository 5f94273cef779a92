"""Joins whose small side has a known bound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Most rows a checked side may have to be sent to every task.
BROADCAST_ROWS = 200_000


def fixed_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table written in the code: its size does not depend on data."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def small_or_not(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if a count shows that it has at most `limit` rows.

    Beyond that it is left to a shuffled join, whose skewed keys AQE splits.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread_join(big: DataFrame, side: DataFrame, keys: Sequence[str], row_key: Column,
                how: str = "left", salts: int = 16, share: int = 1000,
                side_rows: int | None = None) -> DataFrame:
    """Join to a side with few rows per key where some keys fill much of `big`.

    A side small enough by count is broadcast. Otherwise rows of frequent keys are spread
    over `salts` copies of the side's rows; fewer than `share` keys can hold more than
    1/share of the rows, so only those are copied.
    """
    checked = small_or_not(side) if side_rows is None else (
        F.broadcast(side) if side_rows <= BROADCAST_ROWS else side)
    if checked is not side:
        return big.join(checked, list(keys), how)
    return salted_join(big, side, keys, row_key, how, salts, share)


def salted_join(big: DataFrame, side: DataFrame, keys: Sequence[str], row_key: Column,
                how: str = "left", salts: int = 16, share: int = 1000) -> DataFrame:
    """The shuffled form of `spread_join`."""
    sizes = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(sizes.where(F.col("_n") * share > total).select(
        *keys, F.lit(True).alias("_hot")))
    left = big.join(hot, list(keys), "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(row_key), F.lit(salts))).otherwise(F.lit(0)))
    right = side.join(hot, list(keys), "left").withColumn("_salt", F.explode(
        F.when(F.col("_hot"), F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
        .otherwise(F.array(F.lit(0).cast("bigint")))))
    return left.drop("_hot").join(right.drop("_hot"), [*keys, "_salt"], how).drop("_salt")
