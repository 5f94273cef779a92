"""The source registry: which corpora there are, how many rows each may give, how often."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators.joins import fixed_table
from ..session import scratch_path

SCHEMA = "name string, renderer string, licence string, cap bigint, scan bigint, weight bigint"


def registry(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return fixed_table(spark, rows or V.SOURCE_MIX, SCHEMA)


def validation_cap(cap, parts: int = V.REASON_HOLDOUT, least: int = 50):
    """Cap of the validation side."""
    return F.greatest(F.floor(cap / parts), F.lit(least))


def empty_sources(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(source, n, empty) for every registered source, also those that gave nothing."""
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    found = names.join(counts, "source", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.withColumn("empty", F.col("n") == 0)


def assert_not_empty(rows: DataFrame, names: DataFrame) -> None:
    """Raise if a registered source gave no row."""
    missing = [r["source"] for r in empty_sources(rows, names).where("empty").take(20)]
    if missing:
        raise RuntimeError(f"no rows from {', '.join(missing)}")


def gather(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): the sources' rows with their `source`, and a row for each that failed.

    Each source is opened and written on its own, so one that is missing, has changed its columns
    or holds a damaged file costs its own rows only. (source, stage, error): `stage` is `open`,
    `read`, or `schema` for columns other than those of the first source that could be read. All
    sources failing is an error.
    """
    parts: list[DataFrame] = []
    errors: list[tuple[str, str, str]] = []
    for name, open_source in sources.items():
        stage, path = "open", scratch_path(spark, "source")
        try:
            found = open_source()
            stage = "schema"
            if parts and found.columns != (columns := [c for c in parts[0].columns if c != "source"]):
                raise ValueError(f"columns {found.columns}, not {columns}")
            stage = "read"
            found.write.parquet(path)
            parts.append(spark.read.schema(found.schema).parquet(path).withColumn("source", F.lit(name)))
        except Exception as e:  # whatever a source fails with is reported, not raised
            errors.append((name, stage, f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}"))
    if not parts:
        raise RuntimeError(f"no source could be read: {errors}")
    return reduce(DataFrame.unionByName, parts), spark.createDataFrame(errors, "source string, stage string, error string")
