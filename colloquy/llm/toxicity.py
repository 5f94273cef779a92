"""Toxicity by compression distance: two zstandard dictionaries, one of toxic, one of
ordinary text; every word of a text is compressed with both.

What decides is the pair of lengths. A word that only the toxic dictionary knows becomes
short with it and stays long with the other. Pairs are calibrated on labelled documents: each
pair has a log ratio of how often it falls into toxic and ordinary ones. A document's
evidence is the sum of the ratios above a floor over its number of words, and the threshold
is the one with the best F1 on the labelled sample.

Two things about zstandard shape the windows. A block that is not clearly shorter than its
input is stored as it is, and the last bytes of a block are not searched; so every window
gets the same ending, which both dictionaries know. And toxic documents are mostly made of
ordinary words; so the toxic dictionary is made of their contrasting words, those with a
piece of PIECE bytes that is found in far more toxic than ordinary documents. Dictionaries
that zstandard selects by itself from all toxic text were tried; see the README.

The sample the dictionaries, ratios and threshold are fitted on has a bound: at most
MAX_TOXIC and MAX_ORDINARY documents of at most MAX_BYTES, chosen by a hash of their id.
Everything else is over all rows, and every whole text is scored.

Defined cases: null and empty texts score 0; a null label is no label, and of several labels
for one id the greatest counts; rows without an id are scored and never held out; without
labelled documents of both kinds nothing can be learned, and every score is 0; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import chunks, hash_words

MAX_TOXIC = 1500
MAX_ORDINARY = 4000
MAX_BYTES = 32_000
PIECE = 6           # bytes of a contrasting piece
PIECE_Z = 6.0       # least deviation, in standard errors, of its share in toxic documents
PIECE_DOCS = 5      # toxic documents it must be in at least
DICTIONARY = 16_384
LEVEL = 3
SIDE = 64           # lengths told apart
FLOOR = 1.0         # log ratios below count as no evidence
PRIOR_WORDS = 30    # added to a text's number of words
CUT = 0.7           # the score at the threshold
ENDING = b" the words of one window end here, as they stand: "
CHUNK = 4 << 20


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    ratios: np.ndarray      # by (length with ordinary, length with toxic), flattened
    shortest: int
    threshold: float


def _window(word: bytes) -> bytes:
    return b" " + word + b" "


def _lengths(dictionary: bytes, words: list[bytes]) -> np.ndarray:
    """Compressed bytes of every word's window."""
    if not words:
        return np.zeros(0, np.int64)
    tool = zstandard.ZstdCompressor(
        level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        write_checksum=False, write_content_size=False, write_dict_id=False)
    data = b" " + (b" " + ENDING + b" ").join(words) + b" " + ENDING
    size = np.fromiter(map(len, words), np.uint64, len(words)) + np.uint64(2 + len(ENDING))
    parts = np.column_stack([np.cumsum(size) - size, size])
    done = tool.multi_compress_to_buffer(zstandard.BufferWithSegments(data, parts.tobytes()), threads=0)
    return np.fromiter(map(len, done), np.int64, len(words))


def _cells(model: Model, words: list[bytes]) -> np.ndarray:
    a, b = _lengths(model.ordinary, words), _lengths(model.toxic, words)
    low = model.shortest
    return np.clip(a - low, 0, SIDE - 1) * SIDE + np.clip(b - low, 0, SIDE - 1)


def fit(texts: list[bytes], labels: list[int]) -> Model | None:
    """The model from a bounded list of labelled texts."""
    y = np.array(labels, bool)
    if y.all() or not y.any():
        return None
    bags = [Counter(t.split()) for t in texts]

    def pieces(word: bytes) -> set[bytes]:
        w = _window(word)
        return {w[i:i + PIECE] for i in range(max(1, len(w) - PIECE + 1))}

    found = [Counter(), Counter()]
    for bag, toxic in zip(bags, y):
        found[int(toxic)].update({p for w in bag for p in pieces(w)})
    n = (int((~y).sum()), int(y.sum()))

    def contrast(p: bytes) -> float:
        a, b = found[1][p], found[0][p]
        share = (a + b) / len(y)
        return (a / n[1] - b / n[0]) / np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-12)

    marked = {p for p, a in found[1].items() if a >= min(PIECE_DOCS, n[1]) and contrast(p) >= min(PIECE_Z, 0.5 * len(y) ** 0.5)}
    toxic_words, plain_words = Counter(), Counter()
    for bag, toxic in zip(bags, y):
        into = toxic_words if toxic else plain_words
        for w, k in bag.items():
            if toxic == bool(pieces(w) & marked):
                into[w] += k

    def content(words: Counter) -> bytes:
        # The most frequent come last, next to the window; ties by the word itself.
        order = sorted(words, key=lambda w: (-words[w], w))
        kept, size = [], 0
        for w in order:
            size += len(w) + 2
            if size > DICTIONARY:
                break
            kept.append(_window(w))
        return b"".join(reversed(kept)) + ENDING

    model = Model(content(plain_words), content(toxic_words), np.zeros(SIDE * SIDE), 0, 0.0)
    words = sorted(set().union(*bags))
    at = {w: i for i, w in enumerate(words)}
    both = np.minimum(_lengths(model.ordinary, words), _lengths(model.toxic, words))
    model = Model(model.ordinary, model.toxic, model.ratios, int(both.min(initial=0)), 0.0)
    cells = _cells(model, words)
    tall = np.zeros((2, SIDE * SIDE))
    flat = [(np.fromiter((at[w] for w in bag), np.int64, len(bag)), np.fromiter(bag.values(), np.int64, len(bag))) for bag in bags]
    for (i, k), toxic in zip(flat, y):
        np.add.at(tall[int(toxic)], cells[i], k)
    rate = max(tall[1].sum(), 1) / max(tall[0].sum(), 1)
    ratios = np.log((tall[1] + 2 * rate) / ((tall[0] + 2) * rate))
    ratios = np.where(ratios > FLOOR, ratios, 0.0)
    evidence = np.array([(ratios[cells[i]] * k).sum() / (k.sum() + PRIOR_WORDS) for i, k in flat])
    order = np.argsort(-evidence, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.append(np.diff(evidence[order]) < 0, True) & (evidence[order] > 0)
    if not ends.any():
        return None
    best = int(np.argmax(np.where(ends, f1, -1)))
    below = evidence[order][best + 1] if best + 1 < len(y) else 0.0
    return Model(model.ordinary, model.toxic, ratios, model.shortest, float((evidence[order][best] + below) / 2))


def score_texts(model: Model | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores of the texts of a chunk. Every distinct word is compressed once."""
    n = len(offsets) - 1
    hashes, firsts = hash_words(data, offsets)
    if model is None or not len(hashes):
        return np.zeros(n)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    words = data.tobytes().split() if _split_agrees(data, offsets) else [
        w for i in range(n) for w in data[offsets[i]:offsets[i + 1]].tobytes().split()]
    each = model.ratios[_cells(model, [words[i] for i in first])][which]
    total = np.concatenate([[0.0], np.cumsum(each)])
    counts = np.diff(firsts)
    evidence = (total[firsts[1:]] - total[firsts[:-1]]) / (counts + PRIOR_WORDS)
    evidence = np.where(evidence < 1e-12, 0.0, evidence)
    return np.round(evidence / (evidence + model.threshold * (1 - CUT) / CUT), 6)


def _split_agrees(data: np.ndarray, offsets: np.ndarray) -> bool:
    """Whether no word runs over from one text into the next."""
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    gap = np.isin(data, [32, 9, 10, 11, 12, 13], kind="table") if len(inner) else None
    return not len(inner) or bool((gap[inner] | gap[inner - 1]).all())


def _scorer(model: Model | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1), CHUNK):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a),
                    pa.array(score_texts(model, data, offsets))], ["doc_id", "held_out", "score"])
    return score


def held_out():
    """Rows whose labels are never looked at."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        (F.max("toxic") > 0).cast("int").alias("toxic")).where(~held_out())
    short = docs.where(F.octet_length("text") <= MAX_BYTES).select("doc_id").distinct()
    known = known.join(short, "doc_id")
    order = F.xxhash64("doc_id")
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(MAX_TOXIC).union(
        known.where("toxic = 0").orderBy(order, "doc_id").limit(MAX_ORDINARY))
    # At most MAX_TOXIC + MAX_ORDINARY rows of two numbers.
    sample = docs.join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= MAX_BYTES).select(
        "doc_id", "text", "toxic").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = sorted(sample.collect(), key=lambda r: r["doc_id"])
    return fit([r["text"].encode() for r in rows], [r["toxic"] for r in rows])


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    scored = rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
