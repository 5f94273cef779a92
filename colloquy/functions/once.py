"""Values computed once.

Catalyst may copy an expression into every place that names it, and moves a filter below
the projection it tests, which computes the tested value twice. For a chain of regular
expressions over long texts that is most of the work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once however often the body names it."""
    return F.get(F.transform(F.array(x), body), 0)


def keep_computed(df: DataFrame, columns: dict[str, Column],
                  test: Callable[[Column], Column]) -> DataFrame:
    """Rows with new columns, of which those that pass `test` are kept.

    The test sees the columns as fields of one struct.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    rest = [c for c in df.columns if c not in columns]
    kept = df.withColumn("_made", F.explode(F.filter(F.array(made), test)))
    return kept.select(*rest, *[F.col(f"_made.{name}").alias(name) for name in columns])
