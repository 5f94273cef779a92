"""State carries over batches: many small files give what one batch gives."""

from collections import defaultdict
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from colloquy.plans import catalog
from colloquy.plans.on_streams import suppression_input
from colloquy.plans.registry import Tables
from colloquy.session import scratch_path
from colloquy.streaming import rooms as R
from compare import duck, rows_of


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """The events as a table folder of five files in shuffled time order."""
    folder = str(tmp_path_factory.mktemp("parts"))
    spark.read.parquet(f"{sf}/events.parquet").repartition(5, "event_id").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.fixture(params=[1, 1 << 30])
def replay(request, spark, parts):
    return R.Replay(spark, parts, "events", "ts", "user_id", request.param)


def same(df, con, sql):
    res = con.execute(sql)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in res.description], res.fetchall())


def test_history_over_batches(spark, sf, replay):
    rows = replay.stream.select("event_id", "user_id", "ts", F.concat_ws(" ", "event_type", "props").alias("line"))
    out = R.drain(R.keyed(rows, "user_id", R.RoomHistory("user_id", ["ts", "event_id"]),
                          "event_id bigint, user_id bigint, history string"), "h", replay)
    same(R.on_time(out), duck(sf), catalog.SQL["stream_room_history"])


def test_last_seen_over_batches(spark, sf, replay):
    rows = replay.stream.select("event_id", "user_id", "ts", "event_type", "value")
    out = R.drain(R.keyed(rows, "user_id", R.LastSeen("user_id", ["ts", "event_id"]),
                          "event_id bigint, user_id bigint, seen_image bigint, seen_value double"), "s", replay)
    same(R.on_time(out), duck(sf), catalog.SQL["stream_last_seen"])


def test_suppression_against_a_loop(spark, sf, replay):
    out = R.drain(R.keyed(suppression_input(replay.stream), "user_id",
                          R.RecentSuppression("user_id", ["ts", "event_id"]),
                          "event_id bigint, user_id bigint, reply string, score double"), "r", replay)
    got = {r["event_id"]: r["reply"] for r in R.on_time(out).collect()}
    recent = defaultdict(list)
    for r in suppression_input(Tables(spark, sf).events).orderBy("ts", "event_id").collect():
        last = recent[r["user_id"]][-8:]
        options = [(s, x) for x, s in zip(r["texts"], r["scores"]) if x.lower() not in last]
        choice = max(options)[1] if options else None
        if choice:
            recent[r["user_id"]].append(choice.lower())
        assert got[r["event_id"]] == choice


HISTORY = "event_id bigint, user_id bigint, history string"


def put(spark, folder, rows):
    """Rows (event_id, day, line) of one room as a file of a table folder."""
    df = spark.createDataFrame([(i, 7, day, line) for i, day, line in rows], "event_id bigint, user_id bigint, day double, line string")
    df.select("event_id", "user_id", F.timestamp_millis((F.col("day") * 86_400_000).cast("bigint")).alias("ts"), "line").coalesce(
        1).write.mode("append").parquet(f"{folder}/events.parquet")


def by_loop(rows):
    """event_id -> history, rows in order of time."""
    out, held = {}, []
    for i, _, line in sorted(rows, key=lambda r: (r[1], r[0])):
        out[i] = "\n".join(held[-8:])
        held.append(line)
    return out


@pytest.mark.parametrize("slice_ms", [R.SLICE_MS, None])
def test_a_thousand_days_in_one_room(spark, tmp_path, slice_ms):
    rows = [(i, 10 + (i * 389 % 1000) + i % 7 / 8, f"l{i}") for i in range(3000)]
    for k in range(3):
        put(spark, tmp_path, rows[k::3])
    replay = R.Replay(spark, str(tmp_path), "events", "ts", "user_id", slice_ms=slice_ms)
    made = R.keyed(replay.stream, "user_id", R.RoomHistory("user_id", ["ts", "event_id"], slice_ms=replay.slice_ms), HISTORY)
    out = R.drain(made, "thousand", replay)
    assert {r["event_id"]: r["history"] for r in R.on_time(out).collect()} == by_loop(rows)
    assert R.late_rows(out).count() == 0


def live(spark, folder, lateness, batches):
    """Histories and late rows after each batch of files, and the rows still held."""
    out, marks = scratch_path(spark, "live"), scratch_path(spark, "live-marks")
    put(spark, folder, [])
    got = []
    for rows in batches:
        put(spark, folder, rows)
        stream = R.in_time(R.table_stream(spark, str(folder), "events"), "ts", lateness)
        made = R.keyed(stream, "user_id", R.RoomHistory("user_id", ["ts", "event_id"]), HISTORY)
        with R.state_settings(spark, 1):
            (made.writeStream.partitionBy(R.LATE).format("parquet").option("path", out).option("checkpointLocation", marks)
             .trigger(availableNow=True).start().awaitTermination())
            held = spark.read.format("statestore").option("stateVarName", "sizes").load(marks).count()
        seen = spark.read.schema(made.schema).parquet(out)
        got.append(({r["event_id"]: r["history"] for r in R.on_time(seen).collect()},
                    sorted(r["event_id"] for r in R.late_rows(seen).collect()), held))
    return got


def test_late_rows_are_counted_and_state_is_released(spark, tmp_path):
    rows = [(i, float(i), f"l{i}") for i in range(6)]
    batches = [[rows[0], rows[3]], [rows[1], rows[2], (90, 40.5, "far")], [rows[4], (91, 60.5, "end")], [(92, 75.5, "more")]]
    got = live(spark, tmp_path, timedelta(days=10), batches)
    assert got[0] == ({}, [], 2)  # nothing has passed yet
    assert got[1][0] == by_loop(rows[:4])  # day 40 has passed all of them, whatever their order
    assert got[1][1:] == ([], 1)
    assert got[2][1] == [4]  # its day was handled in the batch before
    assert got[3][0] == by_loop(rows[:4] + [(90, 40.5, "far"), (91, 60.5, "end")])
    assert got[3][1:] == ([4], 1)  # one slice is still held


def test_order_of_batches_does_not_matter_within_the_lateness(spark, tmp_path):
    rows = [(i, i % 20 / 2, f"l{i}") for i in range(60)]
    end = [[(99, 40.5, "end")]]
    ways = [[rows[:30], rows[30:]], [rows[30:], rows[:30]], [rows[::2], rows[1::2]]]
    for k, way in enumerate(ways):
        got = live(spark, tmp_path / str(k), timedelta(days=12), way + end)[-1]
        assert got[0] == by_loop(rows) and got[1] == []


def test_rooms_without_a_name_are_one_room(spark, sf, tmp_path):
    room = F.when(F.col("user_id") % 3 != 0, F.col("user_id"))
    spark.read.parquet(f"{sf}/events.parquet").withColumn("user_id", room).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.PLANS["stream_room_history"](spark, str(tmp_path))
    con = duck(sf)
    con.execute(f"create or replace view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    same(got, con, catalog.SQL["stream_room_history"])


def test_rows_without_a_time_are_late(spark, tmp_path):
    put(spark, tmp_path, [(1, 1.0, "a"), (2, None, "b")])
    replay = R.Replay(spark, str(tmp_path), "events", "ts", "user_id")
    out = R.drain(R.keyed(replay.stream, "user_id", R.RoomHistory("user_id", ["ts", "event_id"], slice_ms=replay.slice_ms), HISTORY), "none", replay)
    assert [r["event_id"] for r in R.on_time(out).collect()] == [1] and [r["event_id"] for r in R.late_rows(out).collect()] == [2]


def test_queries_set_the_state_provider_themselves(spark, sf):
    other = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    plain = spark.newSession()
    plain.conf.set(R.PROVIDER, other)
    assert catalog.PLANS["stream_last_seen"](plain, sf).count() == 210
    assert plain.conf.get(R.PROVIDER) == other


@pytest.mark.parametrize("size", [1, 1 << 30])
def test_session_sums_over_batches(spark, sf, parts, size):
    sums = R.table_stream(spark, parts, "events", size).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    last = {r["user_id"]: r["n"] for r in R.drain_updates(sums, "user_id", "u").collect()}
    assert last == {r["user_id"]: r["count"] for r in
                    spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").count().collect()}


def test_streams_of_missing_and_empty_tables(spark, sf, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        R.table_stream(spark, str(tmp_path), "events")
    spark.read.parquet(f"{sf}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    rows = R.table_stream(spark, str(tmp_path), "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    assert R.drain_updates(rows, "user_id", "none").count() == 0


def test_gate_answers_all_when_set(spark):
    df = spark.createDataFrame([(True, True, True), (False, False, False), (False, True, False)],
                               "is_bot boolean, is_dm boolean, mentioned boolean")
    assert R.message_gate(df).count() == 1 and R.message_gate(df, respond_all=True).count() == 2


def rooms_table(spark, folder, rows):
    """Rows (event_id, room, day, line) as a table of one file."""
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, day double, line string")
    df.select("event_id", "user_id", F.timestamp_millis((F.col("day") * 86_400_000).cast("bigint")).alias("ts"), "line").coalesce(
        1).write.parquet(f"{folder}/events.parquet")


def test_state_is_held_by_buckets_and_not_by_rooms(spark, tmp_path):
    rooms_table(spark, tmp_path, [(i, i, i / 10_000, f"l{i}") for i in range(4000)])
    stream = R.in_time(R.table_stream(spark, str(tmp_path), "events"), "ts", timedelta(days=10))
    made = R.keyed(stream, "user_id", R.RoomHistory("user_id", ["ts", "event_id"]), HISTORY)
    marks = scratch_path(spark, "buckets-marks")
    with R.state_settings(spark, 1):
        (made.writeStream.format("parquet").option("path", scratch_path(spark, "buckets")).option("checkpointLocation", marks)
         .trigger(availableNow=True).start().awaitTermination())
        held = spark.read.format("statestore").option("stateVarName", "sizes").load(marks).count()
    assert 0 < held <= 1024  # all rows are of one slice; with one timer for each room 4,000 were held


@pytest.mark.parametrize("buckets", [1, 3])
def test_rooms_of_a_bucket_are_kept_apart(spark, tmp_path, buckets):
    names = [2**53 + 1, 2**53 + 2, 7, 8, None]
    rows = [(i, names[i * i % 11 % 5], 10 + (i * 389 % 400) / 25, f"l{i}") for i in range(400)]
    rooms_table(spark, tmp_path, rows)
    replay = R.Replay(spark, str(tmp_path), "events", "ts", "user_id", slice_ms=R.SLICE_MS)
    made = R.keyed(replay.stream, "user_id", R.RoomHistory("user_id", ["ts", "event_id"]), HISTORY, buckets)
    got = {r["event_id"]: (r["user_id"], r["history"]) for r in R.on_time(R.drain(made, "apart", replay)).collect()}
    histories = {}
    for name in names:
        histories |= by_loop([(i, day, line) for i, room, day, line in rows if room == name])
    assert got == {i: (room, histories[i]) for i, room, _, _ in rows}


def test_suppression_of_the_query_against_a_loop(spark, sf):
    got = {r["event_id"]: r["reply"] for r in catalog.PLANS["stream_recent_suppression"](spark, sf).collect()}
    recent, wanted = defaultdict(list), {}
    for r in suppression_input(Tables(spark, sf).events).orderBy("ts", "event_id").collect():
        options = [(s, x) for x, s in zip(r["texts"], r["scores"]) if x.lower() not in recent[r["user_id"]][-8:]]
        wanted[r["event_id"]] = max(options)[1] if options else None
        if options:
            recent[r["user_id"]].append(wanted[r["event_id"]].lower())
    assert got == wanted


def test_buckets_follow_the_rows(spark, tmp_path):
    rows = [(i, i % 5000, i / 20_000, "l") for i in range(3 * R.BUCKET_ROWS)]
    rooms_table(spark, tmp_path, rows)
    assert R.Replay(spark, str(tmp_path), "events", "ts", "user_id").buckets == 3
