"""The prefix trie of conversations, its subtree sums found by depth bands.

A node is a distinct sequence of first turns (role, text). A row per conversation and depth
names its node by the depth and the sum of hashes of (place, turn) up to there, so names come
from running sums and no conversation is collected; two 64-bit hashes in four sums of 32-bit
halves make 128 bits.

Subtree sums go up in bands of BAND depths. A node is exploded to its ancestors within its own
band only, BAND at most. Nodes at the top of a band then hold what their band adds; they form a
trie of their own, a BAND-th as deep, which is summed in the same way. Their completed totals
are handed to the ancestors in the band above. So a trie of depth D takes log_BAND(D) rounds and
explodes each node to at most 2 * BAND ancestors, however long a conversation is.

Hot spots: the root and common openings are counted by partial aggregates; nodes meet their
parents in a salted join; a conversation with a third of all rows is placed and summed by blocks
(`operators.scan`). The conversations that end at one node may be a third of all: their ids are
joined to strings in blocks of consecutive ids by many tasks, and one task hashes the strings of
a node as they pass, since a digest has to be taken in order.

Defined results. Rows without a conv_id belong to no conversation. Turns are taken in order of
`turn`, nulls first; those of equal turn by role, then by the digest of the text; repeated rows
are turns of their own. Null role or text is empty, and an empty text is a turn like any other.
Texts are taken whole and only once, to hash and measure them. An empty table has no nodes.
Other columns are left aside, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.joins import spread_join
from colloquy.operators.scan import ranked, running, sliding

from .common import store

BAND = 16
MOST_SHARED = 5   # crc32 % 6
FAMILY = 100
BLOCK_BITS = 16   # ids of one string: 2 ** 16 consecutive numbers
KEY = ["ka", "kb"]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv, at, digest, chars): turns without their texts, numbered from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"), "turn", role.alias("role"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.length(text).cast("bigint").alias("chars"))
    return ranked(slim, ["turn", "role", "digest"], ["conv"], "at").select("conv", "at", "digest", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, depth, digest, chars) of conversations that share openings, from depth 0.

    A conversation c takes the first h turns of c - c % FAMILY and its own after its first h,
    with h = crc32(c) % (MOST_SHARED + 1).
    """
    shared = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(MOST_SHARED + 1)).cast("bigint")
    first = F.col("conv") - F.col("conv") % FAMILY
    # At most MOST_SHARED turns of a conversation, met by at most 2 * FAMILY others.
    heads = turns.where((F.col("at") <= MOST_SHARED) & (F.col("conv") % FAMILY == 0)).groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("at", "digest", "chars"))).alias("head")).withColumnRenamed("conv", "first")
    plans = turns.where("at = 1").select("conv", shared.alias("h"), first.alias("first")).join(heads, "first", "left")
    none = F.array().cast("array<struct<at:bigint,digest:string,chars:bigint>>")
    plans = store(plans.select("conv", F.slice(F.coalesce("head", none), F.lit(1), F.col("h").cast("int")).alias("taken")),
                  "trie-plans")
    lent = plans.select("conv", F.explode("taken").alias("t")).select("conv", F.col("t.at").alias("depth"), "t.digest", "t.chars")
    later = turns.withColumn("h", shared).where("at > h")
    own = spread_join(later, plans.select("conv", F.size("taken").cast("bigint").alias("m")), ["conv"],
                      F.col("at"), "inner").select("conv", (F.col("m") + F.col("at") - F.col("h")).alias("depth"), "digest", "chars")
    roots = plans.select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("digest"),
                         F.lit(0).cast("bigint").alias("chars"))
    return roots.unionByName(lent).unionByName(own)


def named(rows: DataFrame) -> DataFrame:
    """(conv, depth, ka, kb, pa, pb, chars): rows with the names of their node and its parent."""
    low, sums = F.lit(0xFFFFFFFF), {}
    for k in (1, 2):
        h = F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "depth", "digest")).otherwise(F.lit(0).cast("bigint"))
        sums[f"s{2 * k}"], sums[f"s{2 * k + 1}"] = h.bitwiseAND(low), F.shiftrightunsigned(h, 32)
    added = running(rows.withColumns({f"i{n}": c for n, c in sums.items()}), ["depth"], ["conv"],
                    {n: ("sum", F.col(f"i{n}")) for n in sums})

    def name(k: int, depth: Column, parts: list[Column]) -> Column:
        return F.xxhash64(F.lit(k), depth, *parts)
    here = [F.col(n) for n in sums]
    above = [F.col(n) - F.col(f"i{n}") for n in sums]
    inner = F.col("depth") > 0
    return added.select(
        "conv", "depth", "chars", name(1, F.col("depth"), here).alias("ka"), name(2, F.col("depth"), here).alias("kb"),
        F.when(inner, name(1, F.col("depth") - 1, above)).alias("pa"),
        F.when(inner, name(2, F.col("depth") - 1, above)).alias("pb"))


def lines(keyed: DataFrame, step: int, band: int) -> DataFrame:
    """(ka, kb, line) of nodes at multiples of `step`: up to `band` such nodes above and itself."""
    rows = keyed.where(F.col("depth") % step == 0).select("conv", "depth", *KEY)
    lined = sliding(rows, ["depth"], ["conv"], band, {
        "line": lambda frame: F.collect_list(F.struct(*KEY)).over(frame(-band, 0))})
    # All rows of a node have the same line.
    return lined.groupBy(*KEY).agg(F.first("line").alias("line"))


def subtree_sums(keyed: DataFrame, own: DataFrame, values: list[str], deepest: int, band: int = BAND,
                 step: int = 1) -> DataFrame:
    """(ka, kb, values): of each node at a multiple of `step`, the sum of `own` over its subtree."""
    tree = store(own.join(lines(keyed, step, band), KEY), "trie-tree")
    at = F.floor(F.col("depth") / step)
    inside = (at % band + 1).cast("int")
    up = F.explode(F.slice("line", F.size("line") - inside + 1, inside)).alias("up")
    sums = [F.sum(v).alias(v) for v in values]
    here = tree.select(up, *values).groupBy(F.col("up.ka").alias("ka"), F.col("up.kb").alias("kb")).agg(*sums)
    if deepest // step < band:
        return here
    here = store(here, "trie-band")
    tops = tree.where((F.col("depth") > 0) & (at % band == 0)).select(*KEY, "depth", "line")
    inner = tops.select(*KEY, "depth").join(here, KEY)
    done = subtree_sums(keyed, inner, values, deepest, band, step * band)
    # The line of a band's top holds the whole band above it.
    handed = tops.select(*KEY, F.explode(F.slice("line", 1, band)).alias("up")).join(done, KEY).groupBy(
        F.col("up.ka").alias("ka"), F.col("up.kb").alias("kb")).agg(*sums)
    return here.unionByName(handed).groupBy(*KEY).agg(*sums)


def passing_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the strings of each key, joined by commas, as they come in order."""
    key, digest = None, None

    def out(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.string())], names=[*KEY, "ends_sha256"])
    for batch in batches:
        rows = []
        for a, b, text in zip(*[batch.column(n).to_pylist() for n in (*KEY, "ids")]):
            if key != (a, b):
                if key is not None:
                    rows.append((*key, digest.hexdigest()))
                key, digest = (a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        yield out(rows)
    if key is not None:
        yield out([(*key, digest.hexdigest())])


def end_digests(keyed: DataFrame) -> DataFrame:
    """(ka, kb, ends_sha256) of the nodes at which conversations end."""
    last = keyed.groupBy("conv").agg(F.max(F.struct("depth", *KEY)).alias("e")).select("conv", "e.ka", "e.kb")
    # Ids of a node are distinct, so a block holds at most 2 ** BLOCK_BITS of them.
    strings = last.groupBy(*KEY, F.shiftright("conv", BLOCK_BITS).alias("block")).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    ordered = strings.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids")
    return ordered.mapInArrow(passing_digests, "ka bigint, kb bigint, ends_sha256 string")


def trie_nodes(rows: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node from (conv, depth, digest, chars), depths from 0 without gaps."""
    keyed = store(named(store(rows, "trie-rows")), "trie-keys")
    nodes = store(keyed.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.min("depth").alias("depth"),
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("chars").alias("chars")), "trie-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    below = nodes.where("depth > 0").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(
        F.count(F.lit(1)).alias("n_children"))
    family = store(nodes.join(below, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))),
                   "trie-family")
    own = family.select(*KEY, "depth", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
                        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    sums = subtree_sums(keyed, own, ["n_leaves", "saved_tokens"], deepest, band)
    parents = nodes.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    joined = spread_join(family, parents, ["pa", "pb"], F.xxhash64(*KEY)).join(sums, KEY).join(
        end_digests(keyed), KEY, "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """The trie of the conversations as they are rebuilt with shared openings."""
    return trie_nodes(rebuilt(store(turn_rows(conversations), "trie-turns")), band)
