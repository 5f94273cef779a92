"""Documents scored by masked pseudo-likelihood.

A small network predicts every word from the words on both of its sides, never from itself:
embeddings of the SIDE words before and after, one table per place, are summed and squashed,
and a softmax in two steps (a word's upper, then its lower code) gives the probability of the
word's class; that times the word's share of the class in the corpus is the word's
probability. A document's score is the sum of the log-probabilities of all its words.

The vocabulary is every distinct word of the corpus, counted in Spark. Words are hashed to
classes; the number of classes grows as the square root of the vocabulary, so the driver
holds a model of that size. Counts of the HEAD most frequent words go to every task; rarer
words meet theirs in a shuffled join.

Training is data-parallel over all documents. In a round every task takes the shared
parameters, goes through its documents and masks a share of their words, a different one in
each round so that all are predicted once, and hands back its parameters, weighted by the words it saw. Spark sums them
parameter by parameter, in whole numbers, so that the order of arrival does not matter; the
driver only ever holds one set of parameters.

Defined cases: null and empty texts have no words, log-probability 0 and no mean; a text of
one word is predicted from the edges of a text; repeated rows have equal scores; an empty
table leaves the model untrained and gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .wordhash import U64, chunks, hash_words, mix

CODES = 32                # at least; see codes_for
CLASSES = CODES * CODES
EDGE = CLASSES            # stands for places outside the text
SIDE = 2                  # words on each side
WIDTH = 16
SHARE = 4                 # one word in SHARE is masked in a round
ROUNDS = SHARE
HEAD = 1 << 19            # words whose counts go to every task
UNIT = 1e8                # log-probabilities are summed as multiples of 1 / UNIT
BATCH = 4096
RATE = 0.08
SCALE = 1 << 20           # parameters are summed as multiples of 1 / SCALE
PLACES = [k for k in range(-SIDE, SIDE + 1) if k]


def shapes(codes: int) -> dict[str, tuple[int, ...]]:
    return {"table": (len(PLACES), codes * codes + 1, WIDTH), "bias": (WIDTH,), "upper": (WIDTH, codes), "upper_bias": (codes,),
            "given": (codes, WIDTH), "lower": (WIDTH, codes), "lower_bias": (codes, codes)}


def size_of(codes: int) -> int:
    return sum(int(np.prod(s)) for s in shapes(codes).values())


def codes_of(flat: np.ndarray) -> int:
    """The codes of a vector of parameters, from its length."""
    codes = int((len(flat) / (len(PLACES) * WIDTH + 1)) ** 0.5) + 1
    while size_of(codes) > len(flat):
        codes -= 1
    return codes


def codes_for(n_words: int) -> int:
    """Codes for a vocabulary: codes ** 2 classes are the square root of its size at least."""
    return max(CODES, int(np.ceil(n_words ** 0.25)))


def split(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of one vector as the named parameters."""
    out, at = {}, 0
    for name, shape in shapes(codes_of(flat)).items():
        n = int(np.prod(shape))
        out[name] = flat[at:at + n].reshape(shape)
        at += n
    return out


def initial(seed: int = 11, codes: int = CODES) -> np.ndarray:
    flat = np.zeros(size_of(codes), np.float32)
    rng = np.random.default_rng(seed)
    for name, part in split(flat).items():
        if not name.endswith("bias"):
            part[:] = rng.normal(0, 0.1, part.shape)
    return flat


def classes(hashes: np.ndarray, codes: int = CODES) -> np.ndarray:
    return (hashes >> U64(20)).astype(np.int64) % (codes * codes)


@dataclass
class Words:
    """The counted vocabulary: h and n of every word, and how many there are."""
    counts: DataFrame
    size: int


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            h, n = np.unique(hash_words(data, offsets)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])


def count_words(docs: DataFrame, text_col: str = "text") -> Words:
    """How often each word stands in the corpus, by the word's hash."""
    counts = store(docs.select(text_col).mapInArrow(_counter, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-words")
    return Words(counts, counts.count())


def contexts(ids: np.ndarray, firsts: np.ndarray, at: np.ndarray, edge: int = EDGE) -> np.ndarray:
    """Classes around the words at `at`, a row per word; `edge` outside the word's own text."""
    owner = np.searchsorted(firsts, at, side="right") - 1
    low, high = firsts[owner], firsts[owner + 1]
    out = np.empty((len(at), len(PLACES)), np.int64)
    for j, k in enumerate(PLACES):
        p = at + k
        inside = (p >= low) & (p < high)
        out[:, j] = np.where(inside, ids[np.where(inside, p, 0)], edge)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _forward(p: dict, around: np.ndarray, target: np.ndarray):
    h = p["bias"] + p["table"][0][around[:, 0]]
    for j in range(1, len(PLACES)):
        h += p["table"][j][around[:, j]]
    np.tanh(h, out=h)
    upper, lower = np.divmod(target, p["upper"].shape[1])
    first = _softmax(h @ p["upper"] + p["upper_bias"])
    g = h + p["given"][upper]
    second = _softmax(g @ p["lower"] + p["lower_bias"][upper])
    return h, g, upper, lower, first, second


def log_probabilities(p: dict, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    _, _, upper, lower, first, second = _forward(p, around, target)
    rows = np.arange(len(target))
    return np.log(np.maximum(first[rows, upper] * second[rows, lower], 1e-30))


def _sum_rows(into: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(index, kind="stable")
    sorted_ = index[order]
    starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    into[sorted_[starts]] += np.add.reduceat(rows[order], starts, axis=0)


def train_batch(p: dict, memory: dict, grad: dict, around: np.ndarray, target: np.ndarray) -> None:
    """One step of descent; `memory` holds sums of squares that scale the steps."""
    n = len(target)
    rows = np.arange(n)
    h, g, upper, lower, first, second = _forward(p, around, target)
    first[rows, upper] -= 1
    second[rows, lower] -= 1
    first /= n
    second /= n
    for part in grad.values():
        part[:] = 0
    grad["upper"][:] = h.T @ first
    grad["upper_bias"][:] = first.sum(axis=0)
    grad["lower"][:] = g.T @ second
    _sum_rows(grad["lower_bias"], upper, second)
    dg = second @ p["lower"].T
    _sum_rows(grad["given"], upper, dg)
    dh = (first @ p["upper"].T + dg) * (1 - h * h)
    grad["bias"][:] = dh.sum(axis=0)
    for j in range(len(PLACES)):
        _sum_rows(grad["table"][j], around[:, j], dh)
    for name in p:
        memory[name] += grad[name] ** 2
        p[name] -= RATE * grad[name] / (np.sqrt(memory[name]) + 1e-6)


def _masked(hashes: np.ndarray, count: int, turn: int) -> np.ndarray:
    """The words masked in this round: one in SHARE, by place and word."""
    draw = mix(hashes + np.arange(count, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return np.flatnonzero((draw % U64(SHARE)).astype(np.int64) == turn % SHARE)


def _trainer(start: np.ndarray, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, size, codes = start.copy(), len(start), codes_of(start)
        p, grad = split(flat), split(np.zeros(size, np.float32))
        memory = split(np.full(size, 1e-8, np.float32))
        seen, held = 0, []

        def step(least: int) -> None:
            nonlocal held
            if sum(len(t) for _, t in held) < least or not held:
                return
            around, target = (np.concatenate(x) for x in zip(*held))
            end = len(target) if least == 1 else len(target) // BATCH * BATCH
            for a in range(0, end, BATCH):
                train_batch(p, memory, grad, around[a:a + BATCH], target[a:a + BATCH])
            held = [(around[end:], target[end:])]

        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                hashes, firsts = hash_words(data, offsets)
                ids = classes(hashes, codes)
                at = _masked(hashes, len(hashes), turn)
                held.append((contexts(ids, firsts, at, codes * codes), ids[at]))
                seen += len(at)
                step(BATCH)
        step(1)
        if seen:
            weight = max(1, seen >> 8)
            whole = np.rint(flat.astype(np.float64) * SCALE).astype(np.int64) * weight
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(size, dtype=np.int32)), pa.array(whole), pa.array(np.full(size, weight, np.int64))],
                ["at", "total", "weight"])
    return run


def train(docs: DataFrame, rounds: int = ROUNDS, text_col: str = "text", words: Words | None = None) -> np.ndarray:
    """Parameters after `rounds` rounds over all documents."""
    words = count_words(docs, text_col) if words is None else words
    flat = initial(codes=codes_for(words.size))
    texts = docs.select(text_col)
    for turn in range(rounds):
        parts = texts.mapInArrow(_trainer(flat, turn), "at int, total long, weight long")
        sums = parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("weight").alias("weight"))
        mean = store(sums.select("at", (F.col("total") / F.col("weight") / SCALE).cast("double").alias("value")), "lm-mean")
        rows = mean.toArrow()  # one row per parameter, as the root of the vocabulary
        if not rows.num_rows:
            break
        flat = np.zeros(len(flat), np.float32)
        flat[rows["at"].to_numpy()] = rows["value"].to_numpy()
    return flat


def _head(words: Words) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes in order and counts of the at most HEAD words that occur `least` times or more."""
    if words.size <= HEAD:
        least = 1
    else:
        # One row per power of two.
        sizes = words.counts.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()
        tail = words.size
        for b, n in sorted((r["b"], r["count"]) for r in sizes):
            tail -= n
            least = 2 << b
            if tail <= HEAD:
                break
    rows = words.counts.where(F.col("n") >= least).toArrow()
    h, n = rows["h"].to_numpy().view(U64), rows["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order], least


def _scorer(flat: np.ndarray, inside: np.ndarray, head: np.ndarray, counts: np.ndarray, rare: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, codes = split(flat), codes_of(flat)
        row = TaskContext.get().partitionId() << 40
        of_class = np.log(np.maximum(inside, 1))
        of_head = np.log(counts) if len(head) else np.zeros(1)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                hashes, firsts = hash_words(data, offsets)
                ids = classes(hashes, codes)
                logs = np.zeros(len(ids))
                for s in range(0, len(ids), BATCH):
                    at = np.arange(s, min(len(ids), s + BATCH))
                    logs[at] = log_probabilities(p, contexts(ids, firsts, at, codes * codes), ids[at])
                logs -= of_class[ids]
                place = np.minimum(np.searchsorted(head, hashes), max(len(head) - 1, 0))
                known = head[place] == hashes if len(head) else np.zeros(len(hashes), bool)
                logs += np.where(known, of_head[place], 0)
                total = np.append(0, np.cumsum(np.rint(logs * UNIT).astype(np.int64)))
                tail = np.flatnonzero(~known) if rare else np.zeros(0, np.int64)
                tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(tail, firsts).astype(np.int32)), pa.array(hashes[tail].view(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + b - a)), batch.column(0).slice(a, b - a), pa.array(np.diff(firsts)),
                    pa.array(total[firsts[1:]] - total[firsts[:-1]]), tails], ["row", "doc_id", "n_words", "units", "tail"])
                row += b - a
    return run


def score(docs: DataFrame, flat: np.ndarray, words: Words | None = None) -> DataFrame:
    """doc_id, n_words, log_prob, mean_log_prob for every row. A word that `words`, counted in
    `docs` if not given, does not hold is taken as seen once."""
    words = count_words(docs) if words is None else words
    size = codes_of(flat) ** 2
    inside = np.zeros(size, np.int64)
    held = words.counts.groupBy(F.pmod(F.shiftrightunsigned("h", 20), F.lit(size)).alias("c")).agg(F.sum("n").alias("n")).toArrow()
    inside[held["c"].to_numpy()] = held["n"].to_numpy()
    head, counts, least = _head(words)
    scored = docs.select("doc_id", "text").mapInArrow(
        _scorer(flat, inside, head, counts, least > 1), "row long, doc_id long, n_words long, units long, tail array<long>")
    if least > 1:
        # Written, so that rows keep their numbers. Words seen once add log 1 and need no row.
        scored = store(scored, "lm-scored")
        rare = words.counts.where((F.col("n") > 1) & (F.col("n") < least)).select(
            "h", F.round(F.log("n") * UNIT).cast("long").alias("more"))
        more = scored.select("row", F.explode("tail").alias("h")).join(rare, "h").groupBy("row").agg(F.sum("more").alias("more"))
        scored = scored.drop("tail").join(more, "row", "left").withColumn("units", F.col("units") + F.coalesce("more", F.lit(0)))
    scored = scored.select("doc_id", "n_words", F.round(F.col("units") / UNIT, 4).alias("log_prob"))
    return scored.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.round(F.col("log_prob") / F.col("n_words"), 4)))
