"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import scratch_path

# A word is a run of characters other than blank, tab, line feed, VT, FF and return.
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, unchanged; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(folder).rstrip('/')}/{name}.parquet")


_owned: list[list[str]] = []  # paths of the tables made inside each open `inner_tables`


def store(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """`df` written once under the shared folder and read back, so that a lost executor
    costs a reread and not a recomputation. Inside `inner_tables` it goes when that ends; with
    `keep`, when the one around that ends, if there is one."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    owners = _owned[:-1] if keep else _owned
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def inner_tables(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end; nothing that is still to be read may need them."""
    _owned.append([])
    try:
        yield
    finally:
        for path in _owned.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def key_of(column: Column) -> Column:
    """A string key under which nulls are one value of their own."""
    return F.coalesce(F.concat(F.lit("s"), column.cast("string")), F.lit(""))
