"""Outputs: token shards, aligned streams, configuration-keyed folders."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shards
from .fingerprint import fingerprint


def write_token_shards(docs: DataFrame, path: str) -> DataFrame:
    """Write (key, split, ids[, mask]) as token shards; (split, written, tokens, supervised) as the
    tasks that were committed counted them, a few rows per task summed."""
    spark = shards.register(docs.sparkSession)
    docs.write.format(shards.FORMAT).mode("overwrite").save(path)
    return spark.createDataFrame(shards.written_counts(path), "split string, written bigint, tokens bigint, supervised bigint")


def aligned(prompt: Column, target: Column, end_id: int) -> tuple[Column, Column]:
    """Ids of prompt, target and end marker, and the mask that supervises the last two."""
    ids = F.concat(prompt, target, F.array(F.lit(end_id)))
    mask = F.concat(F.array_repeat(F.lit(0), F.size(prompt)),
                    F.array_repeat(F.lit(1), F.size(target) + 1))
    return ids, mask


def action_targets(ids: Column, marker: int, action: Column) -> Column:
    """The action at the last marker, -1 elsewhere; all -1 without marker or action."""
    at = F.array_position(F.reverse(ids), marker).cast("int")
    blank = F.lit(-1)
    return F.when((at > 0) & action.isNotNull(), F.concat(
        F.array_repeat(blank, F.size(ids) - at), F.array(action), F.array_repeat(blank, at - 1))
        ).otherwise(F.array_repeat(blank, F.size(ids)))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def keyed_output(spark: SparkSession, root: str, config: dict, build: Callable[[], DataFrame], cached_only: bool = False,
                 code: Iterable[Callable] = (), vocabulary: Iterable[tuple[str, str]] = ()) -> tuple[str, bool]:
    """(path, reused): the output of this configuration, plan, code and vocabulary, built only if
    it is not complete.

    `build` makes the plan; it is asked for it each time, since the plan names the output. `code`
    are Python functions that run inside it. The data is written first and the configuration
    last, so a job that died halfway is never taken as complete.
    """
    plan = build()
    path = f"{root.rstrip('/')}/{fingerprint(config, plan, code, vocabulary)}"
    if _exists(spark, f"{path}/config/_SUCCESS"):
        return path, True
    if cached_only:
        raise FileNotFoundError(f"no complete output at {path}")
    plan.write.mode("overwrite").parquet(f"{path}/data")
    meta = spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string")
    meta.write.mode("overwrite").json(f"{path}/config")
    return path, False
