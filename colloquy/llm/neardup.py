"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document's set holds its distinct 5-word shingles. The sketch of a set has T coordinates
that are filled in rounds: in round i < T every element falls into a hashed bin with the
value i + hash, in round T + i into bin i; a bin keeps its least value, and rounds stop when
all bins are full. Two rounds of T always fill everything, and agreement of two sketches
concentrates around the Jaccard similarity as independent samples would.

Documents with equal sets are one class from the start. Classes that share a band of
coordinates meet in a bucket; all of them are compared with the bucket's centre, on full
sets. Members already in one component need no further comparison. What is left open is
exact too, without all pairs of a bucket: two sets that are linked share so many shingles
that they share one among the first few of each, whatever the order. Taken from the rarest
on, those of a copy far from the centre are its own edits, which other copies lack, so only
classes that have edits in common are measured. Members that no bucket holds together can be
found that way as well; none that a bucket holds together is lost.

Defined cases: a null or empty text has an empty set, is linked with nothing and is its own
component; rows with a null id can link others but have no id to give; rows that share an id
are one document for `kept`; a component without any id has a null component_id and its rows
are kept; texts of any length are sketched whole, and a set is one value of 8 bytes a shingle;
ties between centres go by the names of classes and do not show in the result; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.joins import small_or_not

from .common import inner_tables, store
from .wordhash import U64, chunks, hash_words, mix, window_hashes, window_starts

WIDTH = 5
T = 128
ROWS = 4  # coordinates per band
SIMILAR_PCT = 75
SLACK = 0.25            # by which agreeing coordinates may fall short of the similarity asked for
GROW = 1.02             # sizes of sets are dealt into ranges whose ends differ by this factor
BATCH = 512             # pairs of sets in a worker at a time
BUCKETS_SENT = 600_000  # most buckets, two short keys each, to be broadcast
FULL = U64(0xFFFFFFFFFFFFFFFF)
SEEDS = mix(np.arange(1, 2 * T + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    hashes, firsts = hash_words(data, offsets, lower=True)
    starts = window_starts(firsts, WIDTH)
    shingles = window_hashes(hashes, starts, WIDTH)
    bounds = np.searchsorted(starts, firsts)
    sets = []
    for i in range(len(firsts) - 1):
        n = firsts[i + 1] - firsts[i]
        if n >= WIDTH:
            sets.append(np.unique(shingles[bounds[i]:bounds[i + 1]]))
        elif n:  # the whole sequence, in a range of its own by its length
            whole = window_hashes(hashes, firsts[i:i + 1], int(n))
            sets.append(mix(whole + U64(n)))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """One row of t filled coordinates per set; sets must not be empty."""
    elements = np.concatenate(sets)
    base = np.repeat(np.arange(len(sets)) * t, [len(s) for s in sets])
    out = np.full(len(sets) * t, FULL, U64)
    for i in range(2 * t):
        h = mix(elements ^ SEEDS[i])
        slot = base + ((h >> U64(40)) % U64(t)).astype(np.int64) if i < t else base + (i - t)
        free = out[slot] == FULL
        value = (U64(i) << U64(40)) | (h & U64((1 << 40) - 1))
        np.minimum.at(out, slot[free], value[free])
        open_sets = (out.reshape(-1, t) == FULL).any(axis=1)
        if not open_sets.any():
            break
        if i % 4 == 0:
            still = open_sets[base // t]
            elements, base = elements[still], base[still]
    return out.reshape(-1, t)


def packed(rows: np.ndarray) -> list[bytes]:
    """Sketches as T numbers of two bytes each."""
    low = mix(rows).astype("<u2")
    return [r.tobytes() for r in low]


def bands():
    """64-bit names of the bands of the column `sketch`."""
    size = 2 * ROWS
    return F.transform(F.sequence(F.lit(0), F.lit(T // ROWS - 1)), lambda i: F.xxhash64(
        F.substring("sketch", i * size + 1, F.lit(size)), i))


def set_key(elements: np.ndarray) -> bytes | None:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in chunks(batch.column(1)):
            sets = shingle_sets(data, offsets)
            filled = [s for s in sets if len(s)]
            sketch = iter(packed(sketches(filled)) if filled else [])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_key(s) for s in sets], pa.binary()),
                pa.array([next(sketch) if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "set_key", "sketch"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            sets = [s for s in shingle_sets(data, offsets) if len(s)]
            yield pa.RecordBatch.from_arrays([
                pa.array([set_key(s) for s in sets], pa.binary()),
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "elements"])


def _alike_batches(least: float):
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, T) for i in (2, 3))
                keep = pa.array((x == y).sum(axis=1) >= T * least)
                yield batch.select(["a", "b"]).filter(keep)
    return sift


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, either = [], []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (v.values.to_numpy().view(U64) for v in (x, y))
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            same = int((y[at] == x).sum())
            shared.append(same)
            either.append(len(x) + len(y) - same)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()),
                                          pa.array(either, pa.int64())], ["a", "b", "shared", "either"])


def _sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node, elements. Sets are made again from the rows with a class's least id; other rows
    with that id give sets that nothing asks for."""
    wanted = nodes.join(classes, "node").select(F.xxhash64("doc_id").alias("rep")).distinct()
    made = docs.withColumn("rep", F.xxhash64("doc_id")).join(small_or_not(wanted), "rep", "left_semi")
    made = made.select("text").mapInArrow(_set_batches, "node binary, elements array<long>").join(nodes, "node", "left_semi")
    return store(made.groupBy("node").agg(F.first("elements").alias("elements")), "near-sets")


def _side_by_side(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """a, b, x, y: the value of both classes of every pair. A centre may meet a third of all
    classes, so it is copied once for every 256 of them."""
    parts = small_or_not(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("parts")))
    right = values.withColumnRenamed("node", "b").join(parts, "b").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = values.withColumnRenamed("node", "a").join(small_or_not(pairs.join(parts, "b")), "a").withColumn(
        "part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    return left.select("a", "b", "part", F.col(name).alias("x")).join(
        right.select("b", "part", F.col(name).alias("y")), ["b", "part"]).select("a", "b", "x", "y")


def measured(pairs: DataFrame, sets: DataFrame, classes: DataFrame, similar_pct: int) -> DataFrame:
    """a, b, shared, either (sizes of intersection and union) of the pairs that may be linked.

    Pairs whose sketches agree in too few coordinates are left out: linked ones agree in three
    quarters, and half would lie six standard deviations below.
    """
    alike = store(_side_by_side(pairs, classes.select("node", "sketch"), "sketch").mapInArrow(
        _alike_batches(similar_pct / 100 - SLACK), "a binary, b binary"), "near-alike")
    return _side_by_side(alike, sets, "elements").mapInArrow(
        _compare_batches, "a binary, b binary, shared long, either long")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of `links` (a, b): the least node reachable.

    Each round takes the least label among the neighbours and then the label of that label,
    so the number of rounds grows with the logarithm of the longest chain.
    """
    both = store(links.select("a", "b").union(links.select("b", "a")).distinct(), "near-links")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("root")), "near-labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("root").alias("r"))
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("b"))
        step = store(step.join(of, "b", "left").select(
            "node", F.least("b", "r").alias("root"), (F.least("b", "r") != F.col("old")).alias("moved")), "near-labels")
        labels = step.select("node", "root")
        if step.where("moved").isEmpty():
            return labels


def _with_roots(df: DataFrame, labels: DataFrame | None, *columns: str) -> DataFrame:
    for c in columns:
        if labels is None:
            df = df.withColumn(f"root_{c}", F.col(c))
            continue
        named = labels.select(F.col("node").alias(c), F.col("root").alias(f"_r_{c}"))
        df = df.join(named, c, "left").withColumn(f"root_{c}", F.coalesce(f"_r_{c}", c)).drop(f"_r_{c}")
    return df


def _buckets(members: DataFrame) -> DataFrame:
    """bucket, node, centre of the buckets with two classes or more.

    The centre is the class whose buckets are the most crowded in sum. What copies of a text have
    in common is the text, so that is the text itself or a copy close to it: the one that most of
    them can be linked to, and the same one in nearly all their buckets.
    """
    crowded = store(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-buckets")
    inside = store(members.join(small_or_not(crowded, BUCKETS_SENT), "bucket"), "near-inside")
    weight = inside.groupBy("node").agg(F.sum("n").alias("weight"))
    # A bucket's greatest member; ties by name.
    heads = inside.drop("n").join(small_or_not(weight, BUCKETS_SENT), "node").groupBy("bucket").agg(
        F.max(F.struct("weight", "node"))["node"].alias("centre"))
    return store(inside.drop("n").join(small_or_not(heads, BUCKETS_SENT), "bucket"), "near-met")


def near_duplicates(docs: DataFrame, similar_pct: int = SIMILAR_PCT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row."""
    docs = docs.select("doc_id", "text")
    rows = store(docs.mapInArrow(_sketch_batches, "doc_id long, n_shingles long, set_key binary, sketch binary")
                 .withColumnRenamed("set_key", "node"), "near-rows")
    classes = store(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")), "near-classes")
    with inner_tables(docs.sparkSession), short_batches(docs.sparkSession):
        labels = class_roots(docs, classes, similar_pct)
    return _named(rows, classes, labels)


def _least_shared(nx, ny, similar_pct: int):
    """Shingles that linked sets of these sizes share at least."""
    return F.ceil(F.lit(similar_pct) * (nx + ny) / F.lit(100 + similar_pct) - 1e-9)


def _first_shingles(members: DataFrame, sets: DataFrame, similar_pct: int) -> DataFrame:
    """token, own, other, id, root, n, place: for each range `other` of sizes a member's partner may
    have, the shingles among which it shares one with every such partner it is linked to.

    Shingles come in one order for all, those in the fewest members first; `place` counts from 0
    and includes the ones that no other member has, which are left out.
    """
    named = sets.join(members.select("node", "id"), "node").select("id", "elements")
    tokens = named.select("id", F.explode("elements").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    order = tokens.join(common, "token").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("held", "token"))).alias("shared"))
    low = F.greatest(F.lit(1.0), F.pow(F.lit(GROW), F.col("other")) - 1e-6)
    high = F.pow(F.lit(GROW), F.col("other") + 1) + 1e-6
    share = similar_pct / 100
    wide = order.join(members.select("id", "root", "n", "own", "others"), "id").withColumn(
        "other", F.explode("others")).where((high >= F.col("n") * share) & (low * share <= F.col("n")))
    alone = F.col("n") - F.size("shared")
    need = F.greatest(F.ceil(F.col("n") * share - 1e-9), _least_shared(F.col("n"), low, similar_pct))
    first = F.slice("shared", 1, F.greatest(F.lit(0), (F.col("n") - need + 1 - alone).cast("int")))
    return wide.select("id", "root", "n", "own", "other", alone.alias("alone"), F.posexplode(first).alias("i", "one")).select(
        F.col("one.token").alias("token"), "own", "other", "id", "root", "n", (F.col("alone") + F.col("i")).alias("place"))


def _sharing(first: DataFrame, similar_pct: int) -> DataFrame:
    """x, y: members of different components that may be linked, by id.

    Of the members that meet under a shingle, those of the component with the most of them are
    not compared with each other.
    """
    key = ["token", "low", "high"]
    first = first.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    most = first.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("m")).groupBy(*key).agg(
        F.max(F.struct("m", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    x = first.join(most, key).where("root <> most.root").select(
        "token", F.col("own").alias("own_x"), F.col("other").alias("own_y"), F.col("id").alias("x"),
        F.col("root").alias("root_x"), F.col("n").alias("nx"), F.col("place").alias("px"))
    y = first.select("token", F.col("own").alias("own_y"), F.col("other").alias("own_x"), F.col("id").alias("y"),
                     F.col("root").alias("root_y"), F.col("n").alias("ny"), F.col("place").alias("py"))
    need = _least_shared(F.col("nx"), F.col("ny"), similar_pct)
    can = (F.col("px") <= F.col("nx") - need) & (F.col("py") <= F.col("ny") - need)
    met = x.join(y, ["token", "own_x", "own_y"]).where((F.col("root_x") != F.col("root_y")) & can)
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Tasks run inside get BATCH rows at a time, since a pair of sets can fill hundreds of kilobytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def class_roots(docs: DataFrame, classes: DataFrame, similar_pct: int) -> DataFrame | None:
    """node, root of the classes that are linked; None if no two classes share a band."""
    met = _buckets(classes.select("node", F.explode(bands()).alias("bucket")))
    if met.isEmpty():
        return None
    spark = docs.sparkSession
    sets = _sets(met.select("node").distinct(), docs, classes)
    seen = labels = None

    def look_at(pairs: DataFrame) -> None:
        """Measure pairs (a, b) not measured yet, and find the components again."""
        nonlocal seen, labels
        with inner_tables(spark):
            pairs = pairs.distinct()
            if seen is not None:
                known = seen.select("a", "b").union(seen.select("b", "a"))
                pairs = pairs.join(known, ["a", "b"], "left_anti")
            found = store(measured(store(pairs, "near-pairs"), sets, classes, similar_pct), "near-found", keep=True)
            seen = found if seen is None else seen.union(found)
            links = seen.where(F.lit(100) * F.col("shared") >= F.lit(similar_pct) * F.col("either"))
            labels = store(components(links), "near-roots", keep=True)

    stars = store(met.where("node <> centre").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("n")), "near-stars")
    # First the centre a class shares most buckets with, then the others it is not yet linked to.
    look_at(stars.groupBy(F.col("node").alias("a")).agg(F.max(F.struct("n", "centre"))["centre"].alias("b")))
    look_at(_with_roots(stars, labels, "node", "centre").where("root_node <> root_centre").select(
        F.col("node").alias("a"), F.col("centre").alias("b")))
    # Members of buckets with more than their centre's component, the ranges of sizes they meet.
    sizes = sets.select("node", F.size("elements").cast("long").alias("n")).withColumn(
        "own", F.floor(F.log("n") / F.log(F.lit(GROW))).cast("int"))
    placed = store(_with_roots(met, labels, "node", "centre").join(sizes, "node"), "near-placed")
    opened = store(placed.groupBy("bucket").agg(
        F.max(F.col("root_node") != F.col("root_centre")).alias("open"), F.collect_set("own").alias("others")).where(
        "open").drop("open"), "near-open")
    members = store(placed.join(small_or_not(opened, BUCKETS_SENT), "bucket").groupBy("node").agg(
        F.first("root_node").alias("root"), F.first("n").alias("n"), F.first("own").alias("own"),
        F.array_distinct(F.flatten(F.collect_list("others"))).alias("others")).withColumn(
        "id", F.monotonically_increasing_id()), "near-members")
    first = store(_first_shingles(members, sets, similar_pct), "near-first")
    name = members.select("id", "node")
    look_at(_sharing(first, similar_pct).join(name.toDF("x", "a"), "x").join(name.toDF("y", "b"), "y").select("a", "b"))
    return store(labels, "near-labels", keep=True)


def _named(rows: DataFrame, classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    ids = _with_roots(classes.select("node", F.col("doc_id").alias("least")), labels, "node")
    ids = ids.join(ids.groupBy("root_node").agg(F.min("least").alias("component_id")), "root_node")
    out = rows.join(ids.select("node", "component_id"), "node", "left").withColumn(
        "component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
