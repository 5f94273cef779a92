"""From traces to shards: budgets, masks, order, and outputs that are used again."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import fixed_values as V
from colloquy.operators import vocabulary as B
from colloquy.session import scratch_path
from colloquy.sources import corpus, shards

MERGES = [("61", "62"), ("6162", "63"), ("20", "61")]


@pytest.fixture(scope="module")
def traces(spark):
    rows = [(i, "even" if i % 2 == 0 else "odd", i % 5 == 0, i // 5 if i % 5 == 0 else i, f"{V.REASON} abc {i}\n{V.THINK}", f" ab ab{i}\n{V.ANSWER} {i}") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id bigint, kind string, held_out boolean, position bigint, prompt string, target string").repartition(7)


def read(spark, path):
    return spark.read.format(shards.FORMAT).load(path)


def test_ids_masks_and_order(spark, traces):
    path, meta = corpus.prepare_traces(traces, MERGES, scratch_path(spark, "p"))
    back = [r.asDict() for r in corpus.trace_rows(read(spark, path), MERGES).collect()]
    want = [r.asDict() for r in traces.collect()]
    assert sorted((r["split"], r["position"], r["doc_id"], r["prompt"], r["target"]) for r in back) == sorted(
        ("val" if r["held_out"] else "train", r["position"], r["doc_id"], r["prompt"], r["target"]) for r in want)
    end = B.bpe_vocab(MERGES, corpus.TAGS)[V.END]
    for r in read(spark, path).collect():
        assert r["ids"][-1] == end and r["mask"] == sorted(r["mask"]) and sum(r["mask"]) > 1
    # Files hold the traces in order.
    parts = [p for p in shards.manifest_of(path)["parts"] if p["split"] == "train"]
    reader = shards.ShardReader(path, "train", 0, 1, "")
    keys = [k for p in reader.partitions() for b in reader.read(p) for k in b.column("key").to_pylist()]
    assert parts and [int(k.split(":")[0]) for k in keys] == sorted(r["position"] for r in want if not r["held_out"])
    assert [(m["split"], m["docs"], m["kinds"]) for m in meta] == [("train", 48, {"even": 24, "odd": 24}), ("val", 12, {"even": 6, "odd": 6})]
    sizes = read(spark, path).groupBy("split").agg(F.sum(F.size("ids")).alias("n")).collect()
    assert {r["split"]: r["n"] for r in sizes} == {m["split"]: m["tokens"] for m in meta}


def test_budget(spark, traces, monkeypatch):
    monkeypatch.setattr(corpus, "VAL_LEAST", 40)
    whole, _ = corpus.prepare_traces(traces, MERGES, scratch_path(spark, "p"))
    cut, meta = corpus.prepare_traces(traces, MERGES, scratch_path(spark, "p"), tokens=300)
    for split, budget in (("train", 300), ("val", 40)):
        sizes = {int(r["key"].split(":")[0]): len(r["ids"]) for r in read(spark, whole).where(F.col("split") == split).collect()}
        total, keep = 0, []
        for position in sorted(sizes):
            if total >= budget:
                break
            keep.append(position)
            total += sizes[position]
        got = sorted(int(r["key"].split(":")[0]) for r in read(spark, cut).where(F.col("split") == split).collect())
        assert got == keep and [m["tokens"] for m in meta if m["split"] == split] == [total]


def test_outputs_are_used_again_until_something_changes(spark, traces, monkeypatch):
    root = scratch_path(spark, "p")
    path, meta = corpus.prepare_traces(traces, MERGES, root)
    monkeypatch.setattr(corpus, "supervised", None)  # nothing is built again
    assert corpus.prepare_traces(traces, MERGES, root) == (path, meta)
    changes = [dict(merges=MERGES[:2]), dict(tokens=10**6), dict(special=corpus.TAGS[::-1]),
               dict(plan=traces.withColumn("target", F.trim("target")))]
    for change in changes:
        with pytest.raises(FileNotFoundError):
            corpus.prepare_traces(**{"traces": traces, "merges": MERGES, "root": root, "cached_only": True, **change})


def test_a_side_without_traces_is_an_error_and_not_complete(spark, traces):
    root = scratch_path(spark, "p")
    with pytest.raises(RuntimeError, match="no traces for val"):
        corpus.prepare_traces(traces.where("NOT held_out"), MERGES, root)
    with pytest.raises(FileNotFoundError):
        corpus.prepare_traces(traces.where("NOT held_out"), MERGES, root, cached_only=True)
