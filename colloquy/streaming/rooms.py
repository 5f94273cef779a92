"""Room messages as a stream: stateless rules, and state kept per room in order of time.

The reference for the state rules is sequential per room. Rooms are dealt into buckets by their
name and a bucket is the unit of state: calls to the state and frames are paid per bucket, not per
room. Rows may come in any order and any batches: a bucket holds them by slices of time and handles
a slice, in order, once the watermark has passed it. So results do not depend on how a table
is cut into files or batches. `lateness` says how long a row may come after later ones. A row
whose slice has been handled, or that has no time, is not placed: it comes out with `late`
set, in a folder of its own, so late rows are counted and not lost.

What a bucket holds is appended in parts and never rewritten; each slice has one timer, which
reads the parts of its own slice only and removes them. No more than one slice of one bucket, and
the few values its rooms carry from slice to slice, is in memory at once, and the rows held are
bounded by `lateness` and the length of a slice.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed_values as V
from ..session import scratch_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"
LATE = "late"
SLICE_MS = 24 * 3600 * 1000
SLICE_ROWS = 100_000  # about as many rows of the busiest bucket in a slice of a replay
STORE_ROWS = 10_000   # a replay opens a state store for so many rows, up to the set number
BUCKET_ROWS = 5_000   # about as many rows in a bucket of rooms of a replay
BUCKETS = 1024        # buckets of a stream that goes on; a checkpoint keeps the number it began with


# -------------------------------------------------------------------- sources
def table_stream(spark: SparkSession, folder: str, name: str, batch_bytes: int = 128 * 1024 * 1024) -> DataFrame:
    """A table, one file or a folder of files, read as a stream with the schema it has now.

    A batch takes about `batch_bytes` and at least one file. A table that is not there is an
    error, as in a batch read.
    """
    path = f"{folder.rstrip('/')}/{name}.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", batch_bytes)
    if any(f.rstrip("/").endswith(f"/{name}.parquet") for f in table.inputFiles()):
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.parquet(path)


def in_time(rows: DataFrame, time: str, lateness: timedelta) -> DataFrame:
    """A stream whose rows may come up to `lateness` after later ones."""
    return rows.withWatermark(time, f"{math.ceil(lateness.total_seconds() * 1000)} milliseconds")


class Replay:
    """A table as a stream that can be closed, after which every row has been handled.

    Without a `lateness` the stream waits for as long as the table spans, so that no row is
    late in whatever order the files come. One row of a far time closes it. The buckets follow
    the number of rows, and the slices are as long as the busiest bucket allows.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str, time: str, room: str,
                 batch_bytes: int = 128 * 1024 * 1024, lateness: timedelta | None = None,
                 slice_ms: int | None = None):
        at = F.col(time).cast("timestamp")
        whole = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
        self.rows = whole.count()
        self.buckets = max(1, math.ceil(self.rows / BUCKET_ROWS))
        buckets = whole.groupBy(bucket_of(room_name(room), self.buckets)).agg(
            F.count(F.lit(1)).alias("n"), F.min(F.unix_millis(at)).alias("low"), F.max(F.unix_millis(at)).alias("high"))
        size = buckets.agg(F.max("n").alias("most"), F.min("low").alias("low"), F.max("high").alias("high")).first()
        low, high, most = size["low"] or 0, size["high"] or 0, size["most"] or 0
        span = high - low + 1
        self.slice_ms = slice_ms or max(1000, math.ceil(span / math.ceil((most + 1) / SLICE_ROWS)))
        wait = timedelta(milliseconds=span) if lateness is None else lateness
        # Past the last slice, however long the stream waits.
        end = high + 2 * self.slice_ms + math.ceil(wait.total_seconds() * 1000)
        self.closing = scratch_path(spark, f"{name}-closing")
        table = table_stream(spark, folder, name, batch_bytes)
        self.row = spark.range(1).select(*[
            (F.timestamp_millis(F.lit(end)) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table.schema])
        self.row.limit(0).write.parquet(self.closing)
        last = spark.readStream.schema(table.schema).parquet(self.closing)
        rows = table.unionByName(last).withColumn(time, F.col(time).cast("timestamp"))
        self.stream = in_time(rows, time, wait)
        self.one_batch = _bytes(spark, f"{folder.rstrip('/')}/{name}.parquet") <= batch_bytes

    def close(self) -> None:
        self.row.write.mode("append").parquet(self.closing)


def _bytes(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


@contextmanager
def state_settings(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """Room state needs the provider named here; a query takes its settings when it starts.

    A small replay (`rows`) opens fewer stores than the session has shuffle partitions.
    """
    wanted = {PROVIDER: ROCKSDB}
    if rows is not None:
        wanted[PARTITIONS] = str(max(1, min(int(spark.conf.get(PARTITIONS)), math.ceil(rows / STORE_ROWS))))
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(stream: DataFrame, name: str, replay: Replay | None = None) -> DataFrame:
    """Process what is there and return what was appended; `replay` is closed first to get
    what waits for later rows. Late rows are in a folder of their own (`late_rows`)."""
    spark = stream.sparkSession
    out, marks = scratch_path(spark, name), scratch_path(spark, f"{name}-marks")
    parts = [c for c in [LATE] if c in stream.columns]

    def run() -> None:
        writer = stream.writeStream.partitionBy(*parts) if parts else stream.writeStream
        (writer.format("parquet").option("path", out).option("checkpointLocation", marks)
         .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    if replay is None:
        run()
    else:
        with state_settings(spark, replay.rows):
            if not replay.one_batch:  # else the closing row may come along with all the others
                run()
            replay.close()
            run()
    return spark.read.schema(stream.schema).parquet(out)


def on_time(handled: DataFrame) -> DataFrame:
    return handled.where(f"NOT {LATE}").drop(LATE)


def late_rows(handled: DataFrame) -> DataFrame:
    """The side output: rows that came after their slice had been handled, or without a time."""
    return handled.where(LATE)


def drain_updates(stream: DataFrame, key: str, name: str) -> DataFrame:
    """Process what is there and return the last state of each key.

    Every batch overwrites its own folder, so a batch that is run again changes nothing.
    """
    spark = stream.sparkSession
    out, marks = scratch_path(spark, name), scratch_path(spark, f"{name}-marks")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    spark.createDataFrame([], schema).write.partitionBy("batch").parquet(out)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (stream.writeStream.foreachBatch(keep).option("checkpointLocation", marks)
             .outputMode("update").trigger(availableNow=True).start())
    query.awaitTermination()
    states = spark.read.schema(schema).parquet(out)
    values = F.struct(*[c for c in stream.columns if c != key])
    return states.groupBy(key).agg(F.max_by(values, "batch").alias("v")).select(key, "v.*")


# ------------------------------------------------------------- stateless rules
def message_gate(messages: DataFrame, respond_all: bool = False) -> DataFrame:
    """Messages a bot answers: never a bot's; direct ones and mentions, or all."""
    wanted = F.lit(True) if respond_all else F.col("is_dm") | F.col("mentioned")
    return messages.where(~F.col("is_bot") & wanted)


def event_dispatch(kind: Column, argument: Column, text: Column, room: Column) -> dict[str, Column]:
    """What to do with an event, on which text, in which room."""
    message = kind == "MESSAGE"
    said = F.coalesce(F.nullif(argument, F.lit("")), F.nullif(text, F.lit("")), F.lit(""))
    return {"action": F.when(kind == "ADDED_TO_SPACE", "greet").when(message, "reply").otherwise("ignore"),
            "said": F.when(message, said), "room": F.when(message, F.coalesce(room, F.lit("dm")))}


# ------------------------------------------------------------------- room state
def room_name(key: str) -> Column:
    """Rooms without a name are one room. A null key beside others would take their rows."""
    return F.coalesce(F.concat(F.lit("r"), F.col(key).cast("string")), F.lit(""))


def bucket_of(name: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).alias("_bucket")


def keyed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """The processor's rows and `late`. Started within `state_settings`, as `drain` does."""
    # As a plain column the time is kept by Spark's own filter of late rows, which drops them.
    rows = stream.withColumn(processor.order[0], F.col(processor.order[0]).alias(processor.order[0], metadata={}))
    # Within the state a room goes by its name, which is never null beside other rooms.
    rows = rows.withColumn(key, room_name(key))
    made = T._parse_datatype_string(f"{schema}, {LATE} boolean")
    named = T.StructType([T.StructField(f.name, T.StringType() if f.name == key else f.dataType) for f in made])
    out = rows.select("*", bucket_of(F.col(key), buckets)).groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=named, outputMode="Append", timeMode="EventTime")
    room = F.when(F.col(key) != "", F.substr(F.col(key), F.lit(2))).cast(made[key].dataType)
    return out.withColumn(key, room)


class InOrder(StatefulProcessor):
    """Rows of a bucket of rooms held by slices of time and handled in order, slice after slice.

    `parts` is a list of appended parts per slice, `sizes` says how many there are, `carried`
    has what each room takes along from one slice to the next.
    """

    def __init__(self, key: str, order: list[str], slice_ms: int = SLICE_MS):
        self.key, self.order, self.slice_ms = key, order, slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sizes = handle.getMapState("sizes", "slice bigint", "n bigint")
        self.parts = handle.getMapState("parts", "slice bigint, part bigint", "rows binary")
        self.carried = handle.getValueState("carried", "rooms binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() // self.slice_ms
        left = []  # the state belongs to this bucket only until the call returns
        for pdf in rows:
            at = pdf[self.order[0]].to_numpy("datetime64[ms]").astype("int64") // self.slice_ms
            late = (at < closed) | pdf[self.order[0]].isna().to_numpy()
            if late.any():
                left.append(self.marked(pdf[["event_id", self.key]][late], True))
            for number, part in pdf[~late].groupby(at[~late]):
                number = int(number)
                held = self.sizes.getValue((number,))
                n = 0 if held is None else held[0]
                self.parts.updateValue((number, n), (pickle.dumps(part),))
                self.sizes.updateValue((number,), (n + 1,))
                if n == 0:
                    self.handle.registerTimer((number + 1) * self.slice_ms)
        return iter(left)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        number = expiredTimerInfo.getExpiryTimeInMs() // self.slice_ms - 1
        parts = []
        for n in range(self.sizes.getValue((number,))[0]):
            parts.append(pickle.loads(self.parts.getValue((number, n))[0]))
            self.parts.removeKey((number, n))
        self.sizes.removeKey((number,))
        held = self.carried.get()
        carried = {} if held is None else pickle.loads(held[0])
        pdf = pd.concat(parts).sort_values(self.order, kind="stable")
        handled = self.step(pdf, carried)
        self.carried.update((pickle.dumps(carried),))
        return iter([self.marked(handled, False)])

    def marked(self, pdf: pd.DataFrame, late: bool) -> pd.DataFrame:
        """`pdf` with every column of the output; those a late row has no value for are null."""
        missing = {name: None for name in self.extra if name not in pdf}
        return pdf.assign(**missing, **{LATE: late})[["event_id", self.key, *self.extra, LATE]]

    def close(self) -> None:
        pass


class RoomHistory(InOrder):
    """Every message with the last lines of its room before it."""

    extra = ["history"]

    def __init__(self, key: str, order: list[str], lines: int = V.HISTORY_LINES, slice_ms: int = SLICE_MS):
        super().__init__(key, order, slice_ms)
        self.n = lines

    def step(self, pdf: pd.DataFrame, carried: dict) -> pd.DataFrame:
        seen = []
        for room, line in zip(pdf[self.key], pdf["line"]):
            held = carried.get(room, [])
            seen.append("\n".join(held))
            carried[room] = [*held, line][-self.n:]
        return pdf[["event_id", self.key]].assign(history=seen)


class LastSeen(InOrder):
    """Questions answered from what the room showed last before them."""

    extra = ["seen_image", "seen_value"]

    def step(self, pdf: pd.DataFrame, carried: dict) -> pd.DataFrame:
        out = []
        for event_id, room, kind, shown in zip(pdf["event_id"], pdf[self.key], pdf["event_type"], pdf["value"]):
            image, value = carried.get(room, (None, None))
            if kind == "click":
                out.append((event_id, room, image, value))
            if kind == "view":
                carried[room] = int(event_id), value
            if kind == "purchase":
                carried[room] = image, float(shown)
        frame = pd.DataFrame(out, columns=["event_id", self.key, "seen_image", "seen_value"])
        return frame.astype({"seen_image": "Int64"})


class RecentSuppression(InOrder):
    """The best candidate that is not among the replies chosen last in the room."""

    extra = ["reply", "score"]

    def __init__(self, key: str, order: list[str], recent: int = V.HISTORY_LINES, slice_ms: int = SLICE_MS):
        super().__init__(key, order, slice_ms)
        self.n = recent

    def step(self, pdf: pd.DataFrame, carried: dict) -> pd.DataFrame:
        out = []
        for event_id, room, texts, scores in zip(pdf["event_id"], pdf[self.key], pdf["texts"], pdf["scores"]):
            recent = carried.get(room, [])
            fresh = [(s, -i, x) for i, (x, s) in enumerate(zip(texts, scores)) if x.lower() not in recent]
            reply, score = None, 0.0
            if fresh:
                score, _, reply = max(fresh)
                carried[room] = [*recent, reply.lower()][-self.n:]
            out.append((event_id, room, reply, float(score)))
        return pd.DataFrame(out, columns=["event_id", self.key, "reply", "score"])


def route_column(command: Column, image: Column, code: Column, move: Column, label: Column,
                 conf: Column, trigger: Column, threshold: float = V.MIN_CONF) -> Column:
    """The first rule that matches names the route."""
    return F.coalesce(
        F.when(command.isNotNull(), F.lit("command")), F.when(image.isNotNull(), F.lit("look")),
        F.when(code.isNotNull(), F.lit("read")), F.when(move, F.lit("move")),
        F.when((conf >= threshold) & (label != V.ROUTES[0]), label), trigger, F.lit(V.ROUTES[0]))
