"""Benchmark decontamination with spaced seeds, with DataFrame functions only.

A mask reads some of the words at a place and ignores the others, so a hash of what it reads
survives substitutions at the ignored places. Two masks of four words, used at every place
they fit, find every window of 9 to 13 words that reaches MATCHES; items of 5 to 8 words get
three further masks, which the documents are only hashed for if there are such items. So
every window that counts is found. Hashes of the benchmark
at every place are joined to hashes of the documents at every place; around a hit the
documents' words are compared with the item's, and the hit counts if some window of WINDOW
aligned words has at least MATCHES equal ones.

Words are compared in lower case, without punctuation marks. The documents are read once and
never shuffled: a bitmap of the benchmark's hashes sieves their places before any row is made of
one, so what is joined are few places with the words around them. Up to SENT_ROWS the hashes are
broadcast; more of them meet the places in a salted join. The bitmap takes half a megabyte at most.

Defined cases: null and empty texts and items have no words and match nothing; an item with
fewer words than WINDOW is compared as a whole, with MATCHES in proportion; one with fewer
words than LEAST is too short to be evidence and not searched; documents are rows, so
repeated rows have equal results; texts of any length are searched whole, and one row holds the
words of one text; the best of several matches counts, so ties do not matter; an item without an
id counts as item null; an empty table
on either side gives no hits; columns of the input that are named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.joins import salted_join, small_or_not

from .common import store

MASKS = ("11101", "100111")
SHORT_MASKS = ("1111", "11011", "10111")  # besides, for items with fewer words than SHORT
LEAST, SHORT = 5, 9
WINDOW = 13
MATCHES = 10
SENT_ROWS = 400_000   # most hashes to be broadcast; a row is three numbers and a short text
MOST_LONGS = 1 << 16  # numbers of 64 bits in the sieve, at least one for two hashes up to here
GAPS = r"""[\x20\x09-\x0D.,;:!?"'()\[\]{}«»“”„…]+"""


def plain_words(text: Column) -> Column:
    """Words in lower case; punctuation marks part words as blanks do."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAPS), "")


def masked(hs: Column, i: Column, seed: int, mask: str) -> Column:
    """What a mask reads at place i, as a hash; near the end, of the words there are."""
    reads = [k for k, c in enumerate(mask) if c == "1"]
    # Every second mask reads backwards, so that its hashes are not the others'.
    return F.xxhash64(*[F.get(hs, i + k) for k in (reads[::-1] if seed % 2 else reads)])


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def seed_hashes(ws: Column, masks: Sequence[str] = MASKS) -> Column:
    """For each mask in turn, a hash per word place."""
    def one(hs: Column, k: int, mask: str) -> Column:
        return F.transform(hs, lambda _, i: masked(hs, i, k, mask))

    def of(hs: Column) -> Column:
        return F.concat(*[one(hs, k, m) for k, m in enumerate(masks)])
    return F.get(F.transform(F.array(word_hashes(ws)), of), 0)


def benchmark_seeds(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """h, item, j, item_n, near (the item's words around j), from: where `near` begins."""
    rows = benchmark.select(F.col(id_col).alias("item"), F.explode(F.array(plain_words(F.col(text_col)))).alias("iw"))

    def seeds(some: DataFrame, masks: Sequence[str]) -> DataFrame:
        out = some.select("item", "iw", F.posexplode(seed_hashes(F.col("iw"), masks)).alias("p", "h"))
        n = F.size("iw")
        span = F.get(F.array(*[F.lit(len(m)) for m in masks]), F.floor(F.col("p") / n).cast("int"))
        out = out.withColumns({"j": F.col("p") % n, "item_n": n, "span": span}).where("j <= item_n - span")
        # Windows that hold all the words of the mask.
        low = F.greatest(F.lit(0), F.col("j") + F.col("span") - WINDOW)
        return out.select("h", "item", "j", "item_n", low.alias("from"), F.slice(
            "iw", low + 1, F.least(n, F.col("j") + WINDOW) - low).alias("near"))
    return seeds(rows.where(F.size("iw") >= SHORT), MASKS).union(
        seeds(rows.where(F.size("iw").between(LEAST, SHORT - 1)), MASKS + SHORT_MASKS))


def best_match(ws: Column, at: Column, near: Column, item_n: Column) -> Column:
    """Most equal words in a window of WINDOW aligned words, or of the whole item if that is
    shorter; `near[0]` is aligned with `ws[at]`, where `at` may lie before the text."""
    size = F.least(F.lit(WINDOW), item_n)

    def over(equal: Column) -> Column:
        start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

        def step(a: Column, k: Column) -> Column:
            now = a["now"] + F.get(equal, k) - F.coalesce(F.get(equal, k - size), F.lit(0))
            return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))
        return F.aggregate(F.sequence(F.lit(0), F.size(near) - 1), start, step)["most"]
    equal = F.transform(near, lambda w, q: F.coalesce((F.get(ws, at + q) == w).cast("int"), F.lit(0)))
    return F.get(F.transform(F.array(equal), over), 0)


def sieve(seeds: DataFrame, longs: int) -> Column:
    """A bitmap of the hashes in `seeds`: 64 bits in each of `longs` (a power of two) numbers."""
    words = seeds.groupBy(F.shiftright("h", 6).bitwiseAND(F.lit(longs - 1)).alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    held = {r["id"]: r["bits"] for r in words.collect()}  # at most `longs` rows
    # A constant that is read once, when the plan is made.
    return F.from_json(F.lit(str([held.get(i, 0) for i in range(longs)])), "array<bigint>")


def places(texts: DataFrame, masks: Sequence[str], bits: Column, longs: int) -> DataFrame:
    """mark, w, i, h: the places of `texts` (mark, w) where a mask's hash may be the benchmark's.

    A row per word is made and sieved inside one generated loop; only places that pass leave it.
    """
    def in_sieve(h: Column) -> Column:
        word = F.get(bits, F.shiftright(h, 6).bitwiseAND(F.lit(longs - 1)).cast("int"))
        return F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1
    spread = texts.select("mark", "w", word_hashes(F.col("w")).alias("hs")).select("mark", "w", "hs", F.posexplode("hs").alias("i", "_h"))
    hashes = [masked(F.col("hs"), F.col("i"), k, m) for k, m in enumerate(masks)]
    passed = spread.where(reduce(lambda a, b: a | b, [in_sieve(h) for h in hashes]))
    return passed.select("mark", "w", "i", F.explode(F.array(*hashes)).alias("h")).where(in_sieve(F.col("h")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of `docs` with n_items, best_overlap and contaminated."""
    seeds = store(benchmark_seeds(benchmark), "bench-seeds")
    size = seeds.agg(F.count(F.lit(1)).alias("n"), F.min("item_n").alias("least")).first()
    found = None
    mark = F.struct(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("text"))
    if size["n"]:
        masks = MASKS + SHORT_MASKS if size["least"] < SHORT else MASKS
        longs = min(MOST_LONGS, max(64, (1 << (size["n"] - 1).bit_length()) // 2))
        texts = docs.select(mark.alias("mark"), F.explode(F.array(plain_words(F.col("text")))).alias("w"))
        low = F.greatest(F.lit(0), F.col("i") - WINDOW)
        # What is left are few places, each with the words around it.
        near = places(texts, masks, sieve(seeds, longs), longs).select(
            "mark", "h", (F.col("i") - low).alias("pos"), F.slice("w", low + 1, F.lit(2 * WINDOW + 1)).alias("w"))
        hits = near.join(F.broadcast(seeds), "h") if size["n"] <= SENT_ROWS else salted_join(
            store(near, "bench-near"), seeds, ["h"], F.xxhash64("mark"), "inner")
        judged = hits.select("mark", "item", "item_n", best_match(
            F.col("w"), F.col("pos") - F.col("j") + F.col("from"), F.col("near"), F.col("item_n")).alias("most"))
        judged = judged.where(F.col("most") * WINDOW >= F.least(F.lit(WINDOW), F.col("item_n")) * MATCHES)
        found = judged.groupBy("mark", "item").agg(F.max("most").alias("most"))
    rest = [c for c in docs.columns if c not in ("n_items", "best_overlap", "contaminated")]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], mark.alias("_mark"))
    if found is None:
        return rows.drop("_mark").withColumns({"n_items": F.lit(0).cast("bigint"), "best_overlap": F.lit(0),
                                               "contaminated": F.lit(False)})
    per_doc = store(found.groupBy("mark").agg(
        F.countDistinct(F.struct("item")).alias("n_items"), F.max("most").alias("best_overlap")), "bench-found")
    # Documents with a hit: two numbers each, broadcast if a count shows that they are few.
    return rows.join(small_or_not(per_doc.withColumnRenamed("mark", "_mark")), "_mark", "left").drop("_mark").withColumns({
        "n_items": F.coalesce("n_items", F.lit(0)).cast("bigint"),
        "best_overlap": F.coalesce("best_overlap", F.lit(0)), "contaminated": F.col("n_items").isNotNull()})
