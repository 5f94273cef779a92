"""Named queries: a Spark plan over the tables and, where it exists, the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WHERE: dict[str, str] = {}


# Tables whose rows take much work, with the columns that spread them.
SPREAD_KEYS = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"], "pages": ["page_id"],
             "events": ["event_id"], "orders": ["o_orderkey"], "embeddings": ["vec_id"]}


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows over all cores where the files alone would keep most of them idle.

    Work on texts costs far more than moving them. A table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


class Tables:
    """The tables of one folder, read on first use as `t.documents`, `t.events`, .."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df, SPREAD_KEYS[name]) if name in SPREAD_KEYS else df


def query(name: str, sql: str | None = None):
    """Register a plan. `sql` must give the same rows under the same column names."""
    def register(plan: Callable[[Tables], DataFrame]):
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = lambda spark, folder: plan(Tables(spark, folder))
        WHERE[name] = plan.__module__
        if sql is not None:
            SQL[name] = sql
        return plan
    return register
