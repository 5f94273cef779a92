"""The classifier trained in rounds: its best round is kept, and it goes on where it stopped."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import rounds as R
from colloquy.operators.models import words
from colloquy.session import scratch_path

KINDS = {"sea": "wave salt tide gull", "wood": "oak moss fern owl", "sky": "cloud wind star moon"}


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        kind = rng.choices(list(KINDS), [20, 3, 1])[0]
        said = [rng.choice(KINDS[kind].split()) if rng.random() < 0.5 else rng.choice("the a of and to in is".split()) for _ in range(8)]
        rows.append((i, " ".join(said), kind))
    rows += [(900, None, "sea"), (901, "", "wood"), (902, "oak", None), (903, "wave " * 50_000, "sea"), (904, "oak moss", "unseen")]
    df = spark.createDataFrame(rows, "id int, text string, kind string").withColumn("y", F.lit("x")).repartition(5).cache()
    return df.where("id % 3 > 0 OR id = 902").where("id <> 904"), df.where("id % 3 = 0 OR id = 904")


def run(sides, folder=None, **options):
    tokens = F.coalesce(words(F.col("text")), F.array().cast("array<string>"))
    return R.train_in_rounds(*sides, tokens, "kind", folder, features=512, **{"rounds": 5, **options})


def test_the_best_round_is_kept(spark, sides):
    folder = scratch_path(spark, "cls")
    model = run(sides, folder)
    assert model.labels == sorted(KINDS) and [s[0] for s in model.scores] == [1, 2, 3, 4, 5]
    assert model.scores[model.best - 1][1] == max(s[1] for s in model.scores) > 0.9
    assert np.array_equal(model.weights, R._load(spark, folder, model.best, model.weights.shape))
    # A class with one row in twenty is learned too.
    got = R.classify_rows(model, sides[1], "id", words(F.col("text")), "kind")
    right = {r["gold"]: r["a"] for r in got.groupBy("gold").agg(F.avg((F.col("gold") == F.col("pred")).cast("int")).alias("a")).collect()}
    assert right["sky"] > 0.7 and right["sea"] > 0.9 and got.count() == sides[1].count()
    assert got.where("conf < 0.3 OR conf > 1").count() == 0


def test_a_worse_last_round_is_not_kept(spark, sides, monkeypatch):
    good = R.learn_round
    monkeypatch.setattr(R, "learn_round", lambda rows, w, b, rate, n: good(rows, w, b, rate, n) if rate > 0.3 else -w)
    model = run(sides)
    assert model.best < 5 and model.scores[-1][1] < model.scores[model.best - 1][1]


def test_training_resumes(spark, sides, monkeypatch):
    whole = run(sides)
    folder = scratch_path(spark, "cls")
    run(sides, folder, stop_after=2)
    done = []
    good = R.learn_round
    monkeypatch.setattr(R, "learn_round", lambda *a: done.append(1) or good(*a))
    again = run([s.repartition(2) for s in sides], folder)
    assert len(done) == 3 and again.scores == whole.scores and np.array_equal(again.weights, whole.weights)


def test_a_round_does_not_depend_on_how_rows_are_dealt(spark, sides, monkeypatch):
    monkeypatch.setattr(R, "LEARNER_ROWS", 60)
    one, two = run(sides, rounds=2), run([s.repartition(7).orderBy("text") for s in sides], rounds=2)
    assert one.scores == two.scores and np.array_equal(one.weights, two.weights)


def test_nothing_to_learn_from(spark, sides):
    with pytest.raises(ValueError, match="no training rows"):
        run((sides[0].limit(0), sides[1]))
    with pytest.raises(ValueError, match="no held-out rows"):
        run((sides[0], sides[1].limit(0)))


def test_rounds_are_kept_by_a_session_without_arrow(spark, sides):
    key = "spark.sql.execution.arrow.pyspark.enabled"
    before, folder = spark.conf.get(key), scratch_path(spark, "cls")
    spark.conf.set(key, "false")
    try:
        model = run(sides, folder, rounds=2)
        assert np.array_equal(model.weights, R._load(spark, folder, model.best, model.weights.shape)) and model.weights.any()
    finally:
        spark.conf.set(key, before)
    assert run(sides, rounds=2).scores == model.scores
