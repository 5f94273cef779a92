"""Score filters, top-k and choosing among candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import spread_join
from .scan import running


def by_score(group: Sequence[str], score: str, *ties: str):
    return Window.partitionBy(*group).orderBy(F.desc(score), *[F.asc(c) for c in ties])


def topk_filter(df: DataFrame, group: Sequence[str], score: str, k: int) -> DataFrame:
    """Items whose score is not below the k-th best; ties stay.

    The k-th best score is found from the k best distinct counts, so a large group
    sends one row per distinct score of each task's part.
    """
    counts = df.groupBy(*group, score).agg(F.count(F.lit(1)).alias("_n"))
    spec = by_score(group, score)
    ranked = counts.withColumn("_r", F.rank().over(spec)).where(F.col("_r") <= k)
    above = ranked.withColumn("_above", F.coalesce(F.sum("_n").over(
        spec.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    floor = above.where(F.col("_above") < k).groupBy(*group).agg(F.min(score).alias("_floor"))
    return df.join(floor, list(group)).where(F.col(score) >= F.col("_floor")).drop("_floor")


def softmax(df: DataFrame, group: Sequence[str], score: str, temperature: float = 1.0,
            out: str = "p") -> DataFrame:
    """Probabilities within a group.

    Equal scores are counted first; the greatest score and the sum of exponentials against it
    are partial aggregates over the counts. These two numbers per group then meet the rows in
    one join that spreads frequent groups.
    """
    scaled = df.withColumn("_s", F.col(score) / max(temperature, 1e-5))
    counted = scaled.groupBy(*group, "_s").agg(F.count(F.lit(1)).alias("_n"))
    top = counted.groupBy(*group).agg(F.max("_s").alias("_max"))
    total = counted.join(top, list(group)).groupBy(*group, "_max").agg(
        F.sum(F.col("_n") * F.exp(F.col("_s") - F.col("_max"))).alias("_sum"))
    return spread_join(scaled, total, list(group), F.col("_s"), "left").withColumn(
        out, F.exp(F.col("_s") - F.col("_max")) / F.col("_sum")).drop("_s", "_max", "_sum")


def nucleus_filter(df: DataFrame, group: Sequence[str], item: str, p: str, share: float) -> DataFrame:
    """The smallest set of likeliest items that reaches `share`, with the one that crosses it."""
    rows = df.withColumn("_fall", -F.col(p))
    summed = running(rows, ["_fall", item], group, {"before": ("sum", F.col(p))}, inclusive=False)
    return summed.drop("_fall").where(F.col("before") <= share)


def repetition_penalty(score: Column, seen: Column, penalty: float) -> Column:
    return F.when(seen, F.when(score > 0, score / penalty).otherwise(score * penalty)).otherwise(score)


def best_of(df: DataFrame, group: Sequence[str], score: str, tie: str) -> DataFrame:
    """Best row per group, the smallest `tie` among equals.

    Spark drops all but the best row of each group in every task before the shuffle.
    """
    return df.withColumn("_r", F.row_number().over(by_score(group, score, tie))).where(
        "_r = 1").drop("_r")


def legal_best(df: DataFrame, group: Sequence[str], score: str, allowed: str, tie: str) -> DataFrame:
    """Best allowed row per group; of all rows where none is allowed."""
    order = [F.desc(allowed), F.desc(score), F.asc(tie)]
    spec = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(spec)).where("_r = 1").drop("_r")
