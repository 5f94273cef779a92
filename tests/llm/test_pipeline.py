"""The stages against the operators' own rules, each on its own input."""

from collections import Counter

import corpus_pipeline as P
import pytest
from colloquy.llm import mixing
from test_sets import brute_components
from test_llm_text import brute_lines


@pytest.fixture(scope="module")
def staged(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(staged):
    assert all(df.columns == P.COLUMNS for df in staged[1:-1])
    assert all(df.count() > 0 for df in staged)


def test_quality_stage(staged):
    before, after = dict(pairs(staged[0])), dict(pairs(staged[1]))
    for i, text in before.items():
        n, _, _, _, repeats = brute_lines(text)
        assert i not in after or n >= 50 and 100 * repeats <= 50 * n
    assert all(set(t.split("\n")) <= set(before[i].split("\n")) for i, t in after.items())
    assert all(r["n_chars"] == len(r["text"]) for r in staged[1].collect())


def test_near_dedup_stage(staged):
    kept = [i for i, _, _, keep in brute_components(pairs(staged[1])) if keep]
    assert sorted(i for i, _ in pairs(staged[2])) == sorted(kept)


def test_decontamination_stage(spark, sf, staged):
    def grams(text, n=13):
        ws = "".join(" " if c in ".,;:!?\"'()[]{}«»“”„…" else c for c in text.lower()).split()
        return {tuple(ws[k:k + n]) for k in range(len(ws) - n + 1)}
    bench = set().union(*[grams(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    kept = dict(pairs(staged[3]))
    for i, text in pairs(staged[2]):
        if i not in kept:
            continue
        assert not grams(text) & bench
    assert len(kept) < staged[2].count()


def test_mix_stage(staged):
    before, after = pairs(staged[3]), Counter(pairs(staged[4]))
    assert set(after) <= set(before) and max(after.values()) <= 3
    want = {(r["doc_id"]): r["copies"] for r in mixing.mix_words(staged[3]).collect()}
    assert {i: n for (i, _), n in after.items()} == {i: n for i, n in want.items() if n}


def test_sharding_stage(staged):
    rows = staged[5].collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in pairs(staged[4]))
    for shard in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_run_is_the_stages(spark, sf, staged):
    got = Counter(tuple(r) for r in P.run(spark, sf).collect())
    assert got == Counter(tuple(r) for r in staged[5].collect())


def test_stages_on_odd_and_empty_tables(spark, sf, odd, empty):
    for df in (odd, empty):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, df, sf)
            assert out.columns == P.COLUMNS and out.count() <= 3 * df.count()
        assert P.STAGES[-1][1](spark, df, sf).count() == df.count()
