"""Substring deduplication by recompression.

Words are named by hashes, and rounds shorten every text: runs of one symbol become one
symbol, then neighbours whose names fall to the left and to the right side are paired.
Names depend on the words alone, so they are the same in every task, and equal substrings
get the same symbols inside. How many words around a symbol border decide that it stands is
carried along; where those words lie inside a window of W words, every copy of the window
has that border, whatever surrounds it.

Each window has one anchor: the border near its middle that stands at the highest round,
with the symbols that meet there as its key. Consecutive windows with one anchor are one
stretch. Only stretches, about one for five words, are shuffled, as (key, hash of the
stretch's words, document, place):

1. Sorted by that order, in one range exchange that splits frequent keys over many tasks,
   a stretch whose words also occur in a smaller document is settled at once. A key with
   several documents and several stretches leaves the first of each stretch to be looked at.
2. Of those, single windows are hashed and compared: the repeat ends inside the stretch.
3. Each document meets its places and loses the words they cover.

A key that spans two tasks counts as one to be looked at, which costs work and no result.
Windows count as equal if their 128-bit hashes are.

Defined cases: null and empty texts have no words and keep none; texts shorter than a window
lose nothing; a row without an id is neither judged nor compared; rows that share an id are
one document, judged text by text; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .wordhash import U64, chunks, hash_words, mix, spans, window_hashes, window_starts

WINDOW = 13
SIDE = 2        # words on each side of an anchor that its key names too
# As many rounds as borders can stand in at nearly every place of a window: with 13 words a
# second round's borders would be vouched for in the middle only, and anchors would change
# between neighbouring windows, which makes two thirds more stretches to shuffle.
ROUNDS = max(1, int(np.log2(WINDOW / 6.5)))
FAR = 100       # a border that no window can vouch for
_SECOND = 0xC2B2AE3D27D4EB4F  # for the second half of a window's hash


def _meet(left: np.ndarray, right: np.ndarray, start: np.ndarray, end: int, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Words to the left and right of each border that decide a rule on its two symbols:
    both symbols whole, and what decides their outer borders. `edge`: for a border beyond."""
    size = np.diff(np.append(start, end))
    before, after = np.append(FAR, size[:-1]), size
    prior = lambda x, first: np.append(first, x[:-1])
    later = lambda x: np.append(x[1:], edge)
    new_left = np.maximum.reduce([left, before + prior(left, edge), later(left) - after])
    new_right = np.maximum.reduce([right, after + later(right), prior(right, edge) - before])
    return np.minimum(new_left, FAR), np.minimum(new_right, FAR)


def recompress(words: np.ndarray, firsts: np.ndarray, rounds: int = ROUNDS):
    """Per round, over word places: names of the symbols that start there (0: none does), of
    those before them, and the words to the left and right that decide the border."""
    n = len(words)
    opens = np.zeros(n, bool)
    opens[firsts[:-1][firsts[:-1] < n]] = True
    name, start = words.copy(), np.arange(n)
    left = right = np.zeros(n, np.int64)  # between words there is a border in any case
    edge = 0
    for turn in range(rounds):
        for step in ("runs", "pairs"):
            left, right = _meet(left, right, start, n, edge)
            edge = FAR
            first = opens[start]
            left[first] = right[first] = FAR
            if step == "runs":
                gone = np.append(False, name[1:] == name[:-1]) & ~first
                keep = np.flatnonzero(~gone)
                length = np.diff(np.append(keep, len(name)))
                name = np.where(length > 1, mix(name[keep] + U64(0x9E3779B97F4A7C15) * length.astype(U64)), name[keep])
            else:
                side = (mix(name + U64(turn + 1)) & U64(1)).astype(bool)
                gone = np.append(False, ~side[:-1] & side[1:]) & ~first
                keep = np.flatnonzero(~gone)
                paired = np.append(gone[1:], False)[keep]
                follow = np.append(name[1:], U64(0))[keep]
                name = np.where(paired, mix(name[keep] * U64(0x9E3779B97F4A7C15) ^ follow), name[keep])
            start, left, right = start[keep], left[keep], right[keep]
        here, before = np.zeros(n, U64), np.zeros(n, U64)
        here[start] = name
        before[start[1:]] = name[:-1]
        l, r = np.full(n, FAR, np.int16), np.full(n, FAR, np.int16)
        # The key names both symbols, so what decides their outer borders counts, too.
        named_left, named_right = _meet(left, right, start, n, FAR)
        first = opens[start]
        l[start], r[start] = np.where(first, FAR, named_left), np.where(first, FAR, named_right)
        yield here, before, l, r


def stretches(words: np.ndarray, firsts: np.ndarray):
    """first window, number of windows, key and hash of every stretch of windows that share
    an anchor."""
    windows = window_starts(firsts, WINDOW)
    if not len(windows):
        return windows, windows, np.zeros(0, U64), np.zeros(0, U64)
    n = len(words)
    around = np.zeros(n, U64)
    inner = np.arange(SIDE, n - SIDE)
    around[inner] = mix(spans(words, inner - SIDE, inner + SIDE + 1, 0xD6E8FEB86659FD93))
    keys, reach = [around], [(np.zeros(n, np.int16), np.zeros(n, np.int16))]
    for turn, (here, before, l, r) in enumerate(recompress(words, firsts)):
        keys.append(mix(around ^ mix(here + U64(turn)) ^ (before * U64(0xD6E8FEB86659FD93))))
        reach.append((l, r))
    best = np.zeros(len(windows), U64)
    place, level = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int8)
    for offset in range(SIDE, WINDOW - SIDE):
        p = windows + offset
        stands = np.zeros(len(p), np.int8)
        for turn in range(1, len(keys)):
            l, r = reach[turn]
            stands[(l[p] <= offset) & (r[p] <= WINDOW - offset)] = turn
        rank = (stands.astype(U64) << U64(56)) | (around[p] >> U64(8))
        more = rank > best if offset > SIDE else np.ones(len(p), bool)
        best[more], place[more], level[more] = rank[more], p[more], stands[more]
    new = np.ones(len(windows), bool)
    new[1:] = (place[1:] != place[:-1]) | (level[1:] != level[:-1]) | (windows[1:] != windows[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(windows)))
    key = np.stack(keys)[level[at], place[at]]
    first = windows[at]
    whole = mix(spans(words, first, first + count + WINDOW - 1, 0xD6E8FEB86659FD93) + count.astype(U64))
    return first, count, key, whole


def _tag(data: np.ndarray) -> int:
    """26 bits that tell texts with one id apart."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=4).digest(), "little") >> 6


def _pack(first: np.ndarray, count: np.ndarray, tag) -> np.ndarray:
    return (np.asarray(tag, np.int64) << 36) | (first.astype(np.int64) << 4) | (count - 1)


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (place >> 4) & 0xFFFFFFFF, (place & 15) + 1, place >> 36


def _stretch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in chunks(batch.column(1)):
            words, firsts = hash_words(data, offsets)
            first, count, key, whole = stretches(words, firsts)
            if not len(first):
                continue
            owner = np.searchsorted(firsts, first, side="right") - 1
            ids = batch.column(0).slice(a, b - a).to_numpy()
            tags = np.array([_tag(data[offsets[i]:offsets[i + 1]]) for i in range(b - a)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                key.view(np.int64), whole.view(np.int64), ids[owner],
                _pack(first - firsts[owner], count, tags[owner]))], ["key", "whole", "doc_id", "place"])


class _Sorted:
    """Stretches in order of (key, whole, doc_id): which are settled, which to look at."""

    def __init__(self):
        self.run: tuple | None = None   # (key, whole, first document) of the last row
        self.held: list[np.ndarray] = []  # first ones of the last key, while it may be alone
        self.docs: tuple | None = None    # least and greatest document of the last key
        self.several = False              # stretches under the last key
        self.border = True                # the first key may have begun in another task

    def feed(self, key, whole, doc, place):
        n = len(key)
        new_key = np.ones(n, bool)
        new_key[1:] = key[1:] != key[:-1]
        new = new_key.copy()
        new[1:] |= whole[1:] != whole[:-1]
        leader = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        lead = doc[leader]
        if self.run is not None:
            new_key[0] = key[0] != self.run[0]
            new[0] = new_key[0] or whole[0] != self.run[1]
            if not new[0]:
                lead[leader == 0] = self.run[2]
        settled = doc != lead
        looked = []
        starts = np.flatnonzero(new_key)
        if not len(starts) or starts[0] != 0:
            starts = np.append(0, starts)
        ends = np.append(starts[1:], n)
        low, high = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
        kinds = np.add.reduceat(new.astype(np.int64), starts)
        firsts = np.flatnonzero(~settled)
        cut_a, cut_b = np.searchsorted(firsts, starts), np.searchsorted(firsts, ends)
        # Keys that begin and end inside this batch, all at once.
        inside = np.zeros(len(starts), bool)
        inside[1:-1] = (kinds[1:-1] > 1) & (low[1:-1] < high[1:-1])
        if inside.any():
            mark = np.zeros(len(firsts) + 1, np.int64)
            np.add.at(mark, cut_a[inside], 1)
            np.add.at(mark, cut_b[inside], -1)
            looked.append(firsts[np.cumsum(mark)[:-1] > 0])
        out = [np.column_stack([doc[looked[0]], place[looked[0]]])] if looked else []
        for i in sorted({0, len(starts) - 1}):
            if new_key[starts[i]]:
                out += self.close()
                self.docs, self.several, self.border = None, False, self.run is None
            rows = firsts[cut_a[i]:cut_b[i]]
            self.held.append(np.column_stack([doc[rows], place[rows]]))
            self.docs = (low[i], high[i]) if self.docs is None else (min(self.docs[0], low[i]), max(self.docs[1], high[i]))
            self.several |= kinds[i] > 1 or (kinds[i] == 1 and not new_key[starts[i]])
            self.run = (key[ends[i] - 1], whole[ends[i] - 1], lead[ends[i] - 1])
            out += self.flush()
        return np.column_stack([doc[settled], place[settled]]), out

    def flush(self):
        """Held rows once it is known that they must be looked at."""
        if self.border or self.several and self.docs[0] < self.docs[1]:
            return self.close(True)
        return []

    def close(self, sure: bool = False):
        rows, self.held = self.held, []
        return rows if sure or self.border and rows else []


def _settle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: np.ndarray, look: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(np.full(len(rows), look))],
                                          ["doc_id", "place", "look"])
    state = _Sorted()
    for batch in batches:
        if not batch.num_rows:
            continue
        settled, looked = state.feed(*[batch.column(i).to_numpy() for i in range(4)])
        if len(settled):
            yield out(settled, False)
        for rows in looked:
            if len(rows):
                yield out(rows, True)
    state.border = True  # the last key may go on in another task
    for rows in state.close():
        if len(rows):
            yield out(rows, True)


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in chunks(batch.column(1)):
            words, firsts = hash_words(data, offsets)
            found = []
            for i in range(b - a):
                first, count, tag = _unpack(np.asarray(batch.column(2)[a + i].as_py(), np.int64))
                own = _tag(data[offsets[i]:offsets[i + 1]])
                for f, c in {(int(f), int(c)) for f, c in zip(first[tag == own], count[tag == own])}:
                    at = np.arange(f, f + c)
                    found.append(np.column_stack([np.full(c, i), at + firsts[i], at, np.full(c, own)]))
            if not found:
                continue
            rows = np.concatenate(found)
            ids = batch.column(0).slice(a, b - a).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                window_hashes(words, rows[:, 1], WINDOW).view(np.int64),
                window_hashes(words, rows[:, 1], WINDOW, _SECOND).view(np.int64), ids[rows[:, 0]],
                _pack(rows[:, 2], np.ones(len(rows), np.int64), rows[:, 3]))], ["h1", "h2", "doc_id", "place"])


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digests, texts = [], [], [], []
        for text, places in zip(batch.column(1), batch.column(2)):
            raw = b"" if text.as_py() is None else text.as_py().encode()
            words = raw.split()
            kept = words
            if places.as_py():
                first, count, tag = _unpack(np.asarray(places.as_py(), np.int64))
                own = tag == _tag(np.frombuffer(raw, np.uint8))
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, first[own], 1)
                np.add.at(edges, first[own] + count[own] + WINDOW - 1, -1)
                kept = list(compress(words, np.cumsum(edges[:-1]) == 0))
            text = b" ".join(kept)
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(text).hexdigest())
            texts.append(text.decode())
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
            pa.array(digests, pa.string()), pa.array(texts, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def _by_document(places: DataFrame) -> DataFrame:
    """doc_id, places: no more than a document has words."""
    return places.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("place").alias("places"))


def repeated_places(docs: DataFrame) -> DataFrame:
    """doc_id, place of stretches and windows that also start in a smaller document."""
    spark = docs.sparkSession
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    found = rows.mapInArrow(_stretch_batches, "key long, whole long, doc_id long, place long")
    order = ["key", "whole", "doc_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    judged = store(ordered.mapInArrow(_settle_batches, "doc_id long, place long, look boolean"), "sub-judged")
    looks = _by_document(judged.where("look"))
    windows = store(rows.join(looks, rows["doc_id"] == looks["of"]).select("doc_id", "text", "places").mapInArrow(
        _window_batches, "h1 long, h2 long, doc_id long, place long"), "sub-windows")
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"))
    late = windows.join(least, ["h1", "h2"]).where("doc_id > least").select("doc_id", "place")
    return judged.where("NOT look").select("doc_id", "place").union(late)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for every row."""
    docs = docs.select("doc_id", "text")
    places = _by_document(store(repeated_places(docs), "sub-places"))
    joined = docs.join(places, docs["doc_id"] == places["of"], "left").select("doc_id", "text", "places")
    return joined.mapInArrow(_cut_batches, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
