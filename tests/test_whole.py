"""Registered queries take the whole table."""

from pyspark.sql import functions as F

from colloquy.functions import fixed_values as V
from colloquy.operators import metrics
from colloquy.plans import catalog
from colloquy.plans.on_corpora import TRACE_CAP, TRACE_VAL_LEAST


def test_traces_beyond_the_cap_stay(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn(
        "doc_id", F.col("_k") * 1_000_000 + F.col("doc_id")).drop("_k").write.parquet(str(tmp_path / "documents.parquet"))

    def sizes(name):
        rows = catalog.PLANS[name](spark, str(tmp_path)).groupBy("kind", "held_out").count().collect()
        return {(r["kind"], r["held_out"]): r["count"] for r in rows}
    whole, capped = sizes("trace_corpus_whole"), sizes("trace_corpus")
    assert capped == {k: min(n, TRACE_VAL_LEAST if k[1] else TRACE_CAP) for k, n in whole.items()}
    assert sum(whole.values()) > sum(capped.values())


def test_a_long_dialogue_is_rendered_as_one_document(spark, tmp_path):
    turns = [(c, i, "user" if i % 2 == 0 else "bot", f"turn {i} " + "x" * 100) for c, n in ((1, 90), (2, 1)) for i in range(n)]
    turns += [(1, 1000, "system", "not said"), (2, 5, "user", None)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r["doc"] for r in catalog.PLANS["render_dialogue"](spark, str(tmp_path)).collect()}
    lines = "".join(f"{'AB'[i % 2]}: turn {i} {'x' * 100}\n" for i in range(90))
    assert got == {1: f"{lines}{V.DIALOG_SEP}\n", 2: f"A: turn 0 {'x' * 100}\n{V.DIALOG_SEP}\n"}


def test_word_runs_of_a_text_are_built_once(spark, capsys):
    rows = spark.createDataFrame([(1, "a b c d a b c d a"), (2, "a b c"), (3, ""), (4, "a  b c d"), (5, None), (6, "x x x x x")], "i int, t string")
    shares = metrics.repetition(F.split("t", " "), F.col("t"))
    out = rows.select("i", F.split("t", " ").alias("w"), "t").select("i", F.round(metrics.repetition(F.col("w"), F.col("t"))["repeated_4grams"], 4).alias("s"), metrics.ngrams(F.col("w"), 4).alias("g"))
    got = {r["i"]: (r["s"], r["g"]) for r in out.collect()}
    assert got == {1: (0.3333, ["a b c d", "b c d a", "c d a b", "d a b c", "a b c d", "b c d a"]), 2: (0.0, []), 3: (0.0, []),
                   4: (0.0, ["a  b c", " b c d"]), 5: (0.0, []), 6: (0.5, ["x x x x", "x x x x"])}
    rows.select(shares["repeated_4grams"].alias("s")).explain()
    plan = capsys.readouterr().out
    assert plan.count("concat_ws(") == 1 and "array_join(" not in plan
