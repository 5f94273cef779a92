"""Token shards: what is committed can be read, nothing else, and crops read their ranges only."""

import os

import pytest
from pyspark.sql import functions as F

from colloquy.functions.hashing import u32
from colloquy.sources import shards as S


@pytest.fixture(scope="module")
def docs(spark):
    S.register(spark)
    size = F.pmod(F.xxhash64("id"), F.lit(300)).cast("int")
    ids = F.transform(F.sequence(F.lit(0), size), lambda i: F.pmod(F.xxhash64("id", i), F.lit(65536)).cast("int"))
    return spark.range(700).select(
        F.col("id").cast("string").alias("key"), F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"),
        F.slice(ids, F.lit(2), size).alias("ids")).withColumn("mask", F.transform("ids", lambda x: (x % 2).cast("tinyint")))


def rows(df):
    return sorted(tuple(r[c] for c in ("key", "split", "ids", "mask")) for r in df.collect())


def files(path):
    return sorted(os.listdir(f"{path}/parts")) if os.path.isdir(f"{path}/parts") else []


def test_round_trip_and_counts(spark, docs, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    docs.repartition(5).write.format(S.FORMAT).mode("overwrite").save(path)
    back = spark.read.format(S.FORMAT).load(path)
    assert rows(back) == rows(docs)
    assert rows(spark.read.format(S.FORMAT).option("split", "val").load("file://" + path)) == rows(docs.where("split = 'val'"))
    want = docs.groupBy("split").agg(F.count(F.lit(1)), F.sum(F.size("ids")), F.sum(F.aggregate("mask", F.lit(0), lambda a, m: a + m)))
    assert S.written_counts(path) == sorted(tuple(r) for r in want.collect())
    assert sum(os.path.getsize(f"{path}/parts/{f}") for f in files(path) if f.endswith(".ids")) == 2 * sum(r[2] for r in S.written_counts(path))


def test_append_and_overwrite(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    for mode, part in (("append", "id"), ("append", "id")):
        docs.where("split = 'val'").write.format(S.FORMAT).mode(mode).save(path)
    assert S.written_counts(path)[0][1] == 2 * docs.where("split = 'val'").count()
    docs.where("split = 'train'").write.format(S.FORMAT).mode("overwrite").save(path)
    assert rows(spark.read.format(S.FORMAT).load(path)) == rows(docs.where("split = 'train'"))
    assert len(files(path)) == 3 * len(S.manifest_of(path)["parts"])


@pytest.mark.parametrize("bad", ["array(70000)", "array(-1)", "array(cast(null as int))"])
def test_a_failed_write_leaves_nothing(spark, docs, tmp_path, bad):
    path = str(tmp_path / "t")
    broken = docs.drop("mask").withColumn("ids", F.when(F.col("key") == "699", F.expr(bad)).otherwise(F.col("ids")))
    with pytest.raises(Exception, match="16 bits|null among"):
        broken.repartition(6).write.format(S.FORMAT).mode("append").save(path)
    assert S.manifest_of(path) is None
    with pytest.raises(Exception, match="nothing has been committed"):
        spark.read.format(S.FORMAT).load(path).count()
    docs.write.format(S.FORMAT).mode("append").save(path)
    with pytest.raises(Exception, match="16 bits|null among"):
        broken.write.format(S.FORMAT).mode("append").save(path)
    assert rows(spark.read.format(S.FORMAT).load(path)) == rows(docs)
    S.sweep(path)
    assert len(files(path)) == 3 * len(S.manifest_of(path)["parts"])
    assert rows(spark.read.format(S.FORMAT).load(path)) == rows(docs)


def test_files_no_manifest_names_are_not_read(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    docs.write.format(S.FORMAT).mode("append").save(path)
    part = S.ShardWriter(path, False)
    part.write(iter(docs.where("split = 'val'").toArrow().to_batches()))  # a task whose job never committed
    assert rows(spark.read.format(S.FORMAT).load(path)) == rows(docs)
    assert S.sweep(path) == 3 and S.sweep(path) == 0 and S.sweep(str(tmp_path / "none")) == 0


def test_nulls_empty_and_other_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", None, [1, 2], None, "x"), (None, "s", None, None, "x"), ("c", "s", [], [], "x"), ("d", "s", [7], [0], "x")],
                               "key string, split string, ids array<int>, mask array<tinyint>, offset string")
    df.write.format(S.FORMAT).mode("append").save(path)
    assert rows(spark.read.format(S.FORMAT).load(path)) == [("", "s", [], []), ("a", "", [1, 2], [1, 1]), ("c", "s", [], []), ("d", "s", [7], [0])]
    none = str(tmp_path / "none")
    df.limit(0).write.format(S.FORMAT).mode("append").save(none)
    assert spark.read.format(S.FORMAT).load(none).count() == 0
    with pytest.raises(Exception, match="another length"):
        df.withColumn("mask", F.expr("array(cast(1 as tinyint))")).write.format(S.FORMAT).mode("append").save(path)


def test_crops_are_slices_and_read_their_ranges_only(spark, docs, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    docs.repartition(3).write.format(S.FORMAT).mode("append").save(path)
    got = spark.read.format(S.FORMAT).option("crop", 65).option("draws", 2).load(path)
    start = u32("crop", F.concat_ws("-", "key", "k")) % (F.size("ids") - 64)
    want = docs.where(F.size("ids") > 65).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("start", start)
    cut = want.select("key", "k", "start", F.slice("ids", (F.col("start") + 1).cast("int"), F.lit(65)).alias("ids"))
    assert sorted(tuple(r) for r in got.select("key", "k", "start", "ids").collect()) == sorted(tuple(r) for r in cut.collect())

    read = []
    plain = S.ranges
    monkeypatch.setattr(S, "ranges", lambda a, b, wanted: read.append(sum(n for _, n in wanted)) or plain(a, b, wanted))
    reader = S.ShardReader(path, None, 65, 2, "crop")
    crops = sum(len(b) for p in reader.partitions() for b in reader.read(p))
    assert crops == cut.count() and sum(read) == 65 * crops


def test_partitions_follow_the_index(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 50)
    path = str(tmp_path / "t")
    S.ShardWriter(path, False).commit([S.ShardWriter(path, False).write(iter(docs.toArrow().to_batches(max_chunksize=90)))])
    reader = S.ShardReader(path, None, 0, 1, "crop")
    assert len(reader.partitions()) == 560 // 50 + 1 + -(-140 // 50)
    keys = [k for p in reader.partitions() for b in reader.read(p) for k in b.column("key").to_pylist()]
    assert sorted(keys) == sorted(r["key"] for r in docs.select("key").collect())
