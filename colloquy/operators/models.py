"""Count-based and linear models over tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.once import let
from ..session import shared_dir
from .joins import spread_join


def words(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")


def threshold_pick(label: Column, conf: Column, default: str = V.ROUTES[0],
                   threshold: float = V.MIN_CONF) -> Column:
    """The predicted label where it is certain enough, else the default."""
    return F.when(conf >= threshold, label).otherwise(F.lit(default))


# ------------------------------------------------------- naive Bayes by counts
def bag(docs: DataFrame, keys: Sequence[str], tokens: Column) -> DataFrame:
    """(keys, w, n): words counted inside the row, so nothing is shuffled to count them.

    A row without words gives one null word, so that no row is lost.
    """
    return docs.select(*keys, F.explode_outer(word_counts(tokens)).alias("_w")).select(
        *keys, F.col("_w.w").alias("w"), F.coalesce("_w.n", F.lit(0)).cast("bigint").alias("n"))


def word_counts(tokens: Column) -> Column:
    """An array of (w, n), one entry per distinct word: runs of the sorted list."""
    def runs(ws: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(ws)), lambda i: (i == F.size(ws)) | (F.get(ws, i - 1) != F.get(ws, i)))
        return let(ends, lambda e: F.transform(e, lambda i, k: F.struct(
            F.get(ws, i - 1).alias("w"), (i - F.coalesce(F.get(e, k - 1), F.lit(0))).alias("n"))))
    return F.when(F.size(tokens) > 0, let(F.array_sort(tokens), runs))


def naive_bayes_scores(train: DataFrame, rows: DataFrame, key: str, label: str, tokens: Column,
                       labels: Sequence[str]) -> DataFrame:
    """(key, s_<label>..) log scores of multinomial naive Bayes with add-one smoothing.

    Words that training never saw are skipped; a row with no other words gets the priors.
    Only rows of the given labels train, and each label must have some. The model has one
    row per word with the counts of all labels, so a document word meets one row.
    """
    train = train.where(F.col(label).isin(list(labels)))
    by_label = (train.select(label, F.explode(tokens).alias("w")).groupBy(label, "w")
                .agg(F.count(F.lit(1)).alias("n")))
    counts = [F.sum(F.when(F.col(label) == c, F.col("n")).otherwise(0)).alias(f"c{i}")
              for i, c in enumerate(labels)]
    # The learned table is read several times and far smaller than the texts.
    shared_dir(train.sparkSession)
    model = by_label.groupBy("w").agg(*counts).checkpoint()
    # A handful of numbers: words per label, distinct words, documents per label.
    sums = model.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"c{i}").alias(f"c{i}")
                                                     for i in range(len(labels))]).first()
    docs = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if missing := [c for c in labels if c not in docs]:
        raise ValueError(f"no training rows for {missing}")
    all_docs = sum(docs.values())
    joined = spread_join(bag(rows, [key], tokens), model, ["w"], F.col(key), "left", side_rows=sums["v"])

    def score(i: int, c: str) -> Column:
        word = F.log((F.col(f"c{i}") + 1) / F.lit(float(sums[f"c{i}"] + sums["v"])))
        return F.coalesce(F.sum(F.col("n") * word), F.lit(0.0)).alias(f"s_{c}")

    summed = joined.groupBy(key).agg(*[score(i, c) for i, c in enumerate(labels)])
    prior = {c: F.log(F.lit(docs[c] / all_docs)) for c in labels}
    return summed.select(key, *[(F.col(f"s_{c}") + prior[c]).alias(f"s_{c}") for c in labels])


def class_distribution(scores: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Log scores to probabilities p_<label>, with the best label and its confidence."""
    top = F.greatest(*[F.col(f"s_{c}") for c in labels])
    parts = {c: F.exp(F.col(f"s_{c}") - top) for c in labels}
    total = reduce(lambda a, b: a + b, parts.values())
    out = scores.withColumns({f"p_{c}": parts[c] / total for c in labels})
    conf = F.greatest(*[F.col(f"p_{c}") for c in labels])
    pred = F.coalesce(*[F.when(F.col(f"s_{c}") == top, F.lit(c)) for c in labels])
    return out.withColumns({"pred": pred, "conf": conf})


# ----------------------------------------------------------- reply likelihood
def corpus_words(docs: DataFrame, tokens: Column) -> DataFrame:
    """(w, p_all) over a corpus; the total is a scalar subquery."""
    shared_dir(docs.sparkSession)
    counts = (docs.select(F.explode(tokens).alias("w")).groupBy("w")
              .agg(F.count(F.lit(1)).alias("n")).checkpoint())
    return counts.select("w", (F.col("n") / counts.select(F.sum("n")).scalar()).alias("p_all"))


def lm_score(rows: DataFrame, keys: Sequence[str], context: str, reply: str, corpus: DataFrame,
             out: str = "logp", mix: float = 0.4, block: int = 64) -> DataFrame:
    """Mean log-probability of a reply's words given its context's words.

    A word's probability mixes its share in the context with its share in the corpus.
    `context` and `reply` are word arrays; a context too long for the block loses its
    start, the reply is never cut, and an empty reply scores minus infinity.
    """
    room = F.greatest(F.lit(block) - F.size(reply), F.lit(0))
    cut = F.slice(context, F.greatest(F.size(context) - room, F.lit(0)) + 1, F.greatest(room, F.lit(0)))
    trimmed = rows.withColumn("_ctx", cut)
    said = bag(trimmed, [*keys], F.col(reply))
    given = (bag(trimmed, [*keys], F.col("_ctx")).withColumnRenamed("n", "_cn"))
    sizes = trimmed.select(*keys, F.size("_ctx").alias("_len"))
    scored = (spread_join(said, corpus, ["w"], F.xxhash64(*keys), "left")
              .join(given, [*keys, "w"], "left").join(sizes, list(keys)))
    p = ((1 - mix) * F.coalesce(F.col("_cn") / F.greatest(F.col("_len"), F.lit(1)), F.lit(0.0))
         + mix * F.coalesce("p_all", F.lit(1e-9)))
    mean = scored.groupBy(*keys).agg(F.try_divide(F.sum(F.col("n") * F.log(p)), F.sum("n")).alias(out))
    return rows.join(mean, list(keys), "left").withColumn(
        out, F.coalesce(out, F.lit(float("-inf"))))


def mmi(given: Column, alone: Column, weight: float = V.MMI_LAMBDA) -> Column:
    """How much the context raises a reply's likelihood."""
    return given - weight * alone


class Scorer(Protocol):
    """What a plugged-in model has to offer."""

    def logprob(self, context: str, continuation: str) -> float: ...


def scorer_udf(make: Callable[[], Scorer]):
    """A pandas UDF (context, reply) -> log-probability; the model is made once per worker."""
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for contexts, replies in batches:
            yield pd.Series([model.logprob(c or "", r or "") for c, r in zip(contexts, replies)],
                            dtype="float64")
    return score
