"""A linear text classifier trained in rounds, the best round by a held-out score kept.

Texts become hashed word counts once, in Spark. In a round every learner goes over its share of
the rows from the same weights, and the weights are moved by the mean of what the learners
learned, weighted by their rows. Sums are taken over whole numbers, and rows go to learners and
are ordered by hashes, so a round gives the same weights whenever it is run. After each round the
macro accuracy on the held-out rows is measured; the weights of the best round are kept. Each
round is written under the given folder, so training goes on where it stopped.

The driver holds the weights: `features` times the number of labels, whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

FEATURES = 1 << 16
ROUNDS = 8
RATE = 0.5
LEARNER_ROWS = 2000   # rows a learner should have, and
MOST_LEARNERS = 256
WHOLE = 1 << 24       # weights are summed in steps of 1 / WHOLE


@dataclass
class Trained:
    labels: list[str]
    weights: np.ndarray          # (features + 1, labels); the last row is the bias
    scores: list[tuple[int, float, float]]  # (round, macro accuracy, loss) of every round
    best: int


def hashed(rows: DataFrame, tokens: Column, label: str, labels: Sequence[str], features: int) -> DataFrame:
    """(y, ids, h) of rows with one of the labels; `ids` are hashed words, `h` orders the rows."""
    names = F.array(*[F.lit(x) for x in labels])
    ids = F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))
    y = (F.array_position(names, F.col(label)) - 1).cast("int")
    return rows.where(F.col(label).isin(list(labels))).select(y.alias("y"), ids.alias("ids"), F.xxhash64(label, tokens).alias("h"))


def vector(ids: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of length one, and the bias."""
    at, n = np.unique(ids, return_counts=True)
    size = math.sqrt(float((n * n).sum())) or 1.0
    return np.append(at, features), np.append(n / size, 1.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def examples(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    column = batch.column("ids")
    values, ends = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    for i, y in enumerate(batch.column("y").to_pylist()):
        yield y, values[ends[i]:ends[i + 1]]


def learn_round(rows: DataFrame, weights: np.ndarray, balance: np.ndarray, rate: float, learners: int) -> np.ndarray:
    """The weights after one round over (y, ids, h)."""
    features, k = weights.shape[0] - 1, weights.shape[1]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, touched, n = weights.copy(), np.zeros(features + 1, bool), 0
        for batch in batches:
            for y, ids in examples(batch):
                at, x = vector(ids, features)
                g = softmax(x @ own[at])
                g[y] -= 1.0
                own[at] -= rate * balance[y] * np.outer(x, g)
                touched[at] = True
                n += 1
        at = np.nonzero(touched)[0]
        moved = np.rint((own[at] - weights[at]) * n * WHOLE).astype(np.int64)
        lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * k, pa.array(moved.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), lists], names=["at", "moved"])

    spread = rows.repartition(learners, "h").sortWithinPartitions("h", "y")
    found = spread.mapInArrow(learn, "at bigint, moved array<bigint>").groupBy("at").agg(
        *[F.sum(F.get("moved", j)).alias(f"m{j}") for j in range(k)]).toPandas()
    out = weights.copy()
    if len(found):
        total = rows.count()
        out[found["at"].to_numpy()] += found[[f"m{j}" for j in range(k)]].to_numpy() / (WHOLE * total)
    return out


def scored(weights: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    features = weights.shape[0] - 1
    for batch in batches:
        p = [softmax(x @ weights[at]) for at, x in (vector(ids, features) for _, ids in examples(batch))]
        yield batch, np.array(p).reshape(-1, weights.shape[1])


def held_out_score(rows: DataFrame, weights: np.ndarray) -> tuple[float, float]:
    """(macro accuracy, mean loss) over (y, ids, h); classes without rows are left out."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch, p in scored(weights, batches):
            y = batch.column("y").to_numpy()
            loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)) if len(y) else np.array([])
            yield pa.RecordBatch.from_pandas(pd.DataFrame({
                "y": y.astype(np.int64), "good": (p.argmax(1) == y).astype(np.int64) if len(y) else np.array([], np.int64),
                "loss": np.rint(loss * WHOLE).astype(np.int64)}), preserve_index=False)
    per = rows.mapInArrow(measure, "y bigint, good bigint, loss bigint").groupBy("y").agg(
        F.avg("good").alias("a"), F.sum("loss").alias("l"), F.count(F.lit(1)).alias("n")).orderBy("y").collect()
    if not per:
        raise ValueError("no held-out rows with a known label")
    return sum(r["a"] for r in per) / len(per), sum(r["l"] for r in per) / WHOLE / sum(r["n"] for r in per)


def _load(spark: SparkSession, folder: str, number: int, shape: tuple[int, int]) -> np.ndarray:
    found = spark.read.parquet(f"{folder}/round={number}/weights").toPandas()
    weights = np.zeros(shape)
    if len(found):
        weights[found["at"].to_numpy()] = np.stack(found["w"].to_numpy())
    return weights


def _save(spark: SparkSession, folder: str, number: int, weights: np.ndarray, macro: float, loss: float) -> None:
    at = np.nonzero(weights.any(1))[0]
    # Plain lists: a session without Arrow takes no numpy values inside an array.
    spark.createDataFrame(list(zip(at.tolist(), weights[at].tolist())), "at bigint, w array<double>").coalesce(
        1).write.mode("overwrite").parquet(f"{folder}/round={number}/weights")
    # Written last: a round without it has not been finished.
    spark.createDataFrame([(float(macro), float(loss))], "macro double, loss double").write.mode("overwrite").parquet(f"{folder}/round={number}/score")


def train_in_rounds(train: DataFrame, held: DataFrame, tokens: Column, label: str, folder: str | None = None,
                    rounds: int = ROUNDS, features: int = FEATURES, rate: float = RATE, stop_after: int | None = None) -> Trained:
    """Train on `train`, choose on `held`. With a `folder` of an earlier run, finished rounds are taken
    from it. Rates fall over all rounds as half a cosine, down to a tenth. Classes count alike however
    many rows they have. Rows with a null label are left out."""
    spark = train.sparkSession
    folder = folder or scratch_path(spark, "classifier")
    sizes = {r[label]: r["n"] for r in train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        raise ValueError("no training rows with a label")
    labels = sorted(sizes)
    total = sum(sizes.values())
    balance = np.array([total / len(labels) / sizes[x] for x in labels])
    sides = []
    for name, rows in (("train", train), ("held", held)):
        path = scratch_path(spark, f"classifier-{name}")
        hashed(rows, tokens, label, labels, features).write.parquet(path)
        sides.append(spark.read.schema("y int, ids array<int>, h bigint").parquet(path))
    learners = max(1, min(MOST_LEARNERS, total // LEARNER_ROWS))
    weights = np.zeros((features + 1, len(labels)))
    scores: list[tuple[int, float, float]] = []
    for number in range(1, rounds + 1):
        if stop_after is not None and number > stop_after:
            break
        try:
            macro, loss = spark.read.parquet(f"{folder}/round={number}/score").first()
            weights = _load(spark, folder, number, weights.shape)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            now = rate * (0.1 + 0.45 * (1 + math.cos(math.pi * (number - 1) / rounds)))
            weights = learn_round(sides[0], weights, balance, now, learners)
            macro, loss = held_out_score(sides[1], weights)
            _save(spark, folder, number, weights, macro, loss)
        scores.append((number, macro, loss))
    best = max(scores, key=lambda s: (s[1], -s[2], -s[0]))[0]
    return Trained(labels, _load(spark, folder, best, weights.shape), scores, best)


def classify_rows(model: Trained, rows: DataFrame, key: str, tokens: Column, label: str) -> DataFrame:
    """(key, gold, pred, conf) of every row."""
    labels, weights, features = model.labels, model.weights, model.weights.shape[0] - 1
    ids = F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))
    ready = rows.select(key, F.col(label).alias("gold"), F.lit(0).alias("y"), ids.alias("ids"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in scored(weights, batches):
            pred = pa.array([labels[i] for i in p.argmax(1)] if len(p) else [], pa.string())
            conf = pa.array(p.max(1) if len(p) else np.array([]), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pred, conf], names=[key, "gold", "pred", "conf"])
    kinds = dict(ready.dtypes)
    return ready.mapInArrow(judge, f"`{key}` {kinds[key]}, gold {kinds['gold']}, pred string, conf double")
