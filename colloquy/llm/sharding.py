"""Shards of near-equal bytes: minimax contiguous partition of atomic groups.

Documents with equal texts are one atomic group. Groups are ordered by the digest of their
text; the smallest shard capacity under which a greedy pass over that order needs at most
`n_shards` shards is found by binary search, and the order is cut there.

The order may hold billions of groups, so the search works on a summary: sums per digest
prefix. A prefix whose place decides a cut is split into longer prefixes until only single
groups decide, which gives the capacity that a search over all groups would give. The
summary has at most 16 ** FIRST_DIGITS rows plus 256 for each prefix that is split; only it
reaches the driver.

Defined cases: a null text counts as an empty one (size 1, CRC 0); rows with a null id are
placed like others; repeated rows belong to one group and get slots of their own; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

FIRST_DIGITS = 4
MORE_DIGITS = 2


class Summary:
    """Ordered digest prefixes with their bytes; `single` ones hold one group."""

    def __init__(self, items: dict[str, tuple[int, bool]]):
        self.keys = sorted(items)
        self.bytes = [items[k][0] for k in self.keys]
        self.single = [items[k][1] for k in self.keys]
        self.ends = [0, *accumulate(self.bytes)]
        self.total = self.ends[-1]

    def reach(self, start: int, capacity: int, inside: bool) -> int:
        """The furthest place a shard from `start` can end at. With `inside`, a prefix of
        several groups may be cut anywhere, which no real cut can beat."""
        at = bisect_right(self.ends, start + capacity) - 1
        if inside and at < len(self.keys) and not self.single[at]:
            return start + capacity
        return self.ends[at]

    def cuts(self, capacity: int, shards: int, inside: bool = False) -> list[int]:
        """Ends of the greedy shards."""
        places = [0]
        for _ in range(shards):
            places.append(self.reach(places[-1], capacity, inside))
        return places[1:]

    def least_capacity(self, shards: int, inside: bool) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, inside)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def undecided(self, shards: int) -> list[str]:
        """Prefixes of several groups in which a cut of the best partition may lie."""
        low, high = self.least_capacity(shards, True), self.least_capacity(shards, False)
        first, last = self.cuts(low, shards), self.cuts(high, shards, True)
        found = set()
        for a, b in zip(first[:-1], last[:-1]):
            for i in range(max(0, bisect_right(self.ends, a) - 1), len(self.keys)):
                if self.ends[i] >= b:
                    break
                if not self.single[i]:
                    found.add(self.keys[i])
        return sorted(found)

    def even(self, first: int, last: int, start: int, shards: int, capacity: int) -> list[int]:
        """Item indices at which shards of the items first .. last - 1 begin, the first
        shard left out: each cut next to an even share of what is left."""
        ends = [e - start for e in self.ends[first:last + 1]]
        earliest = [ends[-1]]
        for _ in range(shards - 1):
            earliest.append(ends[bisect_left(ends, max(0, earliest[-1] - capacity))])
        earliest, cuts, at = earliest[::-1], [], 0
        for j in range(shards - 1):
            share = at + (ends[-1] - at) / (shards - j)
            i = min(bisect_left(ends, share), len(ends) - 1)
            if i and share - ends[i - 1] <= ends[i] - share:
                i -= 1
            i = max(i, min(bisect_left(ends, at) + 1, len(ends) - 1))  # no shard stays empty
            at = min(max(ends[i], earliest[j]), ends[bisect_right(ends, at + capacity) - 1])
            cuts.append(first + bisect_left(ends, at))
        return cuts

    def balanced(self, shards: int) -> list[str]:
        """First prefix of each shard after the first, under the least capacity.

        A group larger than an even share makes that capacity roomy. It gets a shard of its
        own, and the runs of groups between such groups share the other shards by their size.
        """
        capacity, n = self.least_capacity(shards, False), len(self.keys)
        large = [i for i in range(n) if self.single[i] and self.bytes[i] * shards > self.total]
        runs, at = [], 0
        for i in [*large, n]:
            if i > at:
                runs.append((at, i))
            at = i + 1
        counts = [1] * len(runs)
        size = [self.ends[b] - self.ends[a] for a, b in runs]
        while sum(counts) < shards - len(large):
            counts[max(range(len(runs)), key=lambda r: size[r] / counts[r])] += 1
        cuts = []
        for (a, b), k in zip(runs, counts):
            cuts += [a, *self.even(a, b, self.ends[a], k, capacity)]
        cuts = sorted([*cuts, *large])
        if len(cuts) != shards or max(self.ends[b] - self.ends[a] for a, b in zip(cuts, [*cuts[1:], n])) > capacity:
            cuts = [0, *self.even(0, n, 0, shards, capacity)]
        return [self.keys[i] if i < n else "~" for i in cuts[1:]]


def _prefix_sums(groups: DataFrame, digits: int) -> dict[str, tuple[int, bool]]:
    found = (groups.groupBy(F.substring("digest", 1, digits).alias("p"))
             .agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect())
    return {r["p"]: (r["b"], r["n"] == 1) for r in found}


def shard_starts(groups: DataFrame, n_shards: int) -> list[str]:
    """Digest prefixes at which shards 1, 2, .. begin. `groups`: digest, bytes."""
    digits = FIRST_DIGITS
    items = _prefix_sums(groups, digits)
    if not items:
        return ["~"] * (n_shards - 1)
    while True:
        summary = Summary(items)
        split = summary.undecided(n_shards)
        if not split:
            return summary.balanced(n_shards)
        for p in split:
            del items[p]
        # Prefixes of several lengths can be split in one round; each by two more digits.
        for length in sorted({len(p) for p in split}):
            some = [p for p in split if len(p) == length]
            near = groups.where(F.substring("digest", 1, length).isin(some))
            items |= _prefix_sums(near, length + MORE_DIGITS)


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = store(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("digest")), "shard-rows")
    groups = store(rows.groupBy("digest").agg(F.sum("size").alias("bytes"),
                                              F.count(F.lit(1)).alias("n")), "shard-groups")
    starts = shard_starts(groups, n_shards)
    shard = sum(((F.col("digest") >= s).cast("int") for s in starts), F.lit(0))
    # Slots: rows numbered inside buckets of one shard, after the rows of earlier buckets.
    n_rows = groups.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, round((n_rows / n_shards) ** 0.5))
    placed = rows.withColumns({"shard": shard, "bucket": F.pmod(
        F.xxhash64("doc_id", "digest"), F.lit(buckets))})
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = (Window.partitionBy("shard").orderBy("bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "bucket",
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = Window.partitionBy("shard", "bucket").orderBy("doc_id", "digest")
    return (placed.withColumn("at", F.row_number().over(place))
            .join(offsets, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("at") - 1).cast("bigint").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "digest"))
