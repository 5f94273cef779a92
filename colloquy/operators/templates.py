"""Template phrasings."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slots_of(template: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", template)


def fill(template: Column, values: dict[str, Column]) -> Column:
    """A template with its slots replaced; slots it does not name do nothing."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def expand(rows: DataFrame, templates: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Every row with every template whose slots it has values for.

    Values may be arrays: such a slot gives one row per value, but only under templates
    that name it.
    """
    known = [t for t in templates if set(slots_of(t)) <= set(values)]
    out = rows.withColumn("template", F.explode(F.array(*[F.lit(t) for t in known])))
    scalars: dict[str, Column] = {}
    kinds = dict(rows.select(*[v.alias(k) for k, v in values.items()]).dtypes)
    for name, value in values.items():
        if kinds[name].startswith("array"):
            named = F.contains("template", F.lit("{" + name + "}"))
            out = out.withColumn(f"_{name}", F.explode(
                F.when(named, value).otherwise(F.array(F.lit("")))))
            scalars[name] = F.col(f"_{name}")
        else:
            scalars[name] = value
    return out.withColumn("text", fill(F.col("template"), scalars)).drop(
        *[f"_{n}" for n in values])
