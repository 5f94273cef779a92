"""Scores of predictions, losses, latencies and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import predicates as P
from ..functions.once import let
from .scan import running


def share(test: Column) -> Column:
    """Share of rows that pass; null without rows."""
    return F.avg(F.when(test, 1.0).otherwise(0.0))


def confusion(preds: DataFrame) -> DataFrame:
    """(gold, pred, n). Everything below is computed from such counts or in one pass."""
    return preds.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def per_class(preds: DataFrame, threshold: float = V.MIN_CONF) -> DataFrame:
    hit = F.col("gold") == F.col("pred")
    return preds.groupBy("gold").agg(
        F.count(F.lit(1)).alias("n"), share(hit).alias("accuracy"),
        share(hit & (F.col("conf") >= threshold)).alias("confident"))


def macro_accuracy(preds: DataFrame) -> DataFrame:
    """Mean of the accuracies of the classes that occur."""
    return per_class(preds).agg(F.avg("accuracy").alias("macro"), F.count(F.lit(1)).alias("classes"))


def leakage(preds: DataFrame, default: str = "chat", threshold: float = V.MIN_CONF) -> DataFrame:
    """Share of default-class rows that are confidently sent elsewhere."""
    away = (F.col("pred") != default) & (F.col("conf") >= threshold)
    return preds.where(F.col("gold") == default).agg(
        F.count(F.lit(1)).alias("n"), share(away).alias("leakage"))


def micro_accuracy(hit: Column, counted: Column | None = None) -> Column:
    """Hits over labelled positions, 0 when there is none."""
    counted = F.lit(True) if counted is None else counted
    return F.sum(F.when(counted & hit, 1.0).otherwise(0.0)) / F.greatest(F.count_if(counted), F.lit(1))


def top_confusions(counts: DataFrame, k: int = 5) -> DataFrame:
    """Largest cells off the diagonal."""
    return counts.where("gold <> pred").orderBy(F.desc("n"), F.desc("gold"), F.desc("pred")).limit(k)


def perplexity(loss_sum: Column, n: Column) -> tuple[Column, Column]:
    """Mean loss and its exponent; null where nothing was supervised."""
    mean = loss_sum / F.nullif(n, F.lit(0))
    return mean, F.exp(mean)


def exact_percentiles(df: DataFrame, group: Sequence[str], value: str, shares: dict[str, float],
                      hot_rows: int | None = None) -> DataFrame:
    """Percentiles with linear interpolation, exact and without a list per group.

    Equal values are counted first. A running sum of the counts gives each value its
    range of places, and the places each percentile lies between are picked out.
    """
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counts, [value], group, {"_upto": ("sum", F.col("_n"))}, hot_rows=hot_rows)
    totals = counts.groupBy(*group).agg(F.sum("_n").alias("n"))
    rows = placed.join(totals, list(group))
    picks = []
    for name, p in shares.items():
        at = F.lit(p) * (F.col("n") - 1)
        for part, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{name}_{part}"))
    out = rows.groupBy(*group, "n").agg(*picks)
    columns = []
    for name, p in shares.items():
        at = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        columns.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return out.select(*group, "n", *columns)


def latency_report(df: DataFrame, group: Sequence[str], ms: str) -> DataFrame:
    """Count, mean, percentiles, maximum and population deviation."""
    marks = exact_percentiles(df, group, ms, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    plain = df.groupBy(*group).agg(F.avg(ms).alias("mean"), F.max(ms).alias("max"),
                                   F.stddev_pop(ms).alias("std"))
    return marks.join(plain, list(group))


def budget_report(df: DataFrame, group: Sequence[str], ms: str,
                  budgets: Sequence[tuple[str, float]] = V.BUDGETS_MS) -> DataFrame:
    """Per budget: does the worst case fit, by how much, and what share is over."""
    over = [F.count_if(F.col(ms) > b).alias(f"_o{i}") for i, (_, b) in enumerate(budgets)]
    seen = df.groupBy(*group).agg(F.max(ms).alias("worst"), F.count(F.lit(1)).alias("n"), *over)
    rows = seen.withColumn("_b", F.explode(F.array(*[F.struct(
        F.lit(name).alias("target"), F.lit(b).alias("budget"), F.col(f"_o{i}").alias("over"))
        for i, (name, b) in enumerate(budgets)])))
    return rows.select(*group, F.col("_b.target").alias("target"), F.col("_b.budget").alias("budget"),
                       (F.col("worst") < F.col("_b.budget")).alias("fits"),
                       (F.col("_b.budget") - F.col("worst")).alias("headroom"),
                       (F.col("_b.over") / F.col("n")).alias("share_over"))


def repeated_share(items: Column) -> Column:
    """Share of items that repeat an earlier one; 0 without items."""
    share = let(items, lambda x: 1 - F.size(F.array_distinct(x)) / F.nullif(F.size(x), F.lit(0)))
    return F.coalesce(share, F.lit(0.0))


def ngrams(words: Column, n: int) -> Column:
    """Every n words in a row, joined by a space; words are picked by place, none is copied to a list."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.coalesce(F.transform(starts, lambda w, i: F.concat_ws(
        " ", w, *[F.get(words, i + k) for k in range(1, n)])), F.array().cast("array<string>"))


def repetition(words: Column, text: Column) -> dict[str, Column]:
    """Repeated 4-grams, duplicate lines and short identifiers of a text."""
    return {"repeated_4grams": repeated_share(ngrams(words, 4)),
            "duplicate_lines": repeated_share(F.split(text, "\n", -1)),
            "short_names": F.coalesce(P.short_name_share(text), F.lit(0.0))}
