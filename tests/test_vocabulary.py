"""Learned merges are those of one-by-one merging, and text survives."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.operators import merges as M
from colloquy.operators import vocabulary as B
from colloquy.functions.extract import pre_tokens

SPECIAL = ["<|chat|>", "<|end|>", "<|chat|>x"]


def one_by_one(words: Counter, n: int) -> list[tuple[str, str]]:
    split = {w: [f"{b:02X}" for b in w.encode()] for w in words}
    out = []
    for _ in range(n):
        pairs = Counter()
        for w, c in words.items():
            for p in zip(split[w], split[w][1:]):
                pairs[p] += c
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        out.append(best)
        for w, s in split.items():
            i, new = 0, []
            while i < len(s):
                hit = i + 1 < len(s) and (s[i], s[i + 1]) == best
                new.append(s[i] + s[i + 1] if hit else s[i])
                i += 2 if hit else 1
            split[w] = new
    return out


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    words = ["the", "then", "thread", "naïve", "aaa", "aaaa", "banana", "bandana", "42", "!?"]
    data = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(80)]
    return spark.createDataFrame(data, "id bigint, t string").cache()


def test_learns_the_same_merges(texts):
    counts = Counter()
    for r in texts.select(F.explode(pre_tokens(F.col("t"))).alias("p")).collect():
        counts[r["p"]] += 1
    assert B.bpe_learn(texts, "t", 30) == one_by_one(counts, 30)
    assert B.bpe_learn(texts, "t") == one_by_one(counts, 8000)  # until no pair is left


@pytest.mark.parametrize("bounds", [dict(head_pieces=0), dict(head_pieces=5), dict(head_pieces=40, listed=30, epoch=7),
                                    dict(head_pieces=0, listed=12, epoch=10)])
def test_pieces_that_stay_in_spark_give_the_same_merges(spark, bounds):
    rng = random.Random(9)
    parts = ["ab", "abc", "bca", "cab", "aa", "é", "the", "tion", "a" * 70, "x"]
    counts = Counter({"".join(rng.choice(parts) for _ in range(rng.randint(1, 5))): rng.randint(1, 6) for _ in range(150)})
    pieces = spark.createDataFrame(list(counts.items()), "piece string, n bigint")
    rounds = []
    assert M.learn_merges(pieces, 36, rounds=rounds, **bounds) == one_by_one(counts, 36)
    assert sum(rounds) == 36


def test_merges_foretold_in_another_order_are_taken_where_they_do_not_meet():
    def known():
        return M.Foretold([("a", "b"), ("c", "d"), ("e", "f")], [
            {("a", "b"): -3, ("ab", "e"): 3, ("b", "e"): -3}, {("c", "d"): -2}, {("e", "f"): -4, ("ab", "e"): -3, ("ab", "ef"): 3}])
    left = known()
    assert left.take(("e", "f")) is None and left.take(("x", "y")) is None  # it stands beside (a, b)
    assert left.take(("c", "d")) == {("c", "d"): -2}
    assert left.take(("a", "b")) and left.take(("e", "f")) and not left.left
    assert M.Foretold([("ab", "ab"), ("a", "b")], [{}, {("a", "b"): -1}]).take(("a", "b")) is None


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_do_not_depend_on_what_is_foretold(spark, monkeypatch, seed):
    rng = random.Random(seed)
    counts = Counter({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))): rng.randint(1, 6) for _ in range(120)})
    foretell, shuffled = M.foretell, []

    def mixed(*a):
        first, *rest = foretell(*a)
        rng.shuffle(rest)
        shuffled.append([first, *rest])
        return shuffled[-1]
    monkeypatch.setattr(M, "foretell", mixed)
    rounds = []
    pieces = spark.createDataFrame(list(counts.items()), "piece string, n bigint")
    assert M.learn_merges(pieces, 30, head_pieces=20, rounds=rounds) == one_by_one(counts, 30)
    assert max(rounds) > 1


def test_a_round_reads_only_pieces_that_may_hold_its_pairs(spark):
    counts = Counter({"abab": 9, "cdcd": 3, "efef": 1, "abcd": 2})
    rest = M.Rest(spark.createDataFrame([(n, " ".join(f"{b:02X}" for b in w.encode())) for w, n in counts.items()], "n bigint, symbols string"))
    rest.renew(Counter(), 100)
    assert rest.count["61", "62"] == 20 and rest.floor == 0
    borders = rest.borders([("61", "62"), ("6162", "6162")])
    assert {("61", "62"), ("62", "61")} <= borders and not any("63" in p or "65" in p for p in borders)
    first, second = rest.changes([("61", "62"), ("6162", "6162")])
    assert first == {("61", "62"): -20, ("62", "61"): -9, ("6162", "6162"): 9, ("62", "63"): -2, ("6162", "63"): 2}
    assert second == {("6162", "6162"): -9}


def test_pretokens_are_counted_as_in_a_loop(spark, sf):
    import regex

    from colloquy.functions import fixed_values as V
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = Counter(p for r in docs.collect() for p in regex.findall(V.PRE_TOKEN, r["text"]))
    assert {r["piece"]: r["n"] for r in B.pretoken_counts(docs, "text").collect()} == want


@pytest.mark.parametrize("block", [1000, 3, 0])
def test_encode_decodes_back(spark, texts, block):
    merges = B.bpe_learn(texts, "t", 25)
    cases = ["", "hello", "<|chat|>\nA: hey\nB:", "back-to-back <|chat|><|end|><|chat|>", "café 🙂 naïve",
             "tabs\tand   runs ", "a" * 300, "<|chat|>xy", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    rows = B.bpe_encode(df, ["i"], B.special_pieces(F.col("x"), SPECIAL), merges, SPECIAL, block=block)
    got = rows.withColumn("back", B.bpe_decode(F.col("ids"), merges, SPECIAL)).orderBy("i").collect()
    assert [r["back"] for r in got] == [c or "" for c in cases]
    ids = B.bpe_vocab(merges, SPECIAL)
    assert got[3]["ids"][-3:] == [ids["<|chat|>"], ids["<|end|>"], ids["<|chat|>"]]
    assert got[7]["ids"][0] == ids["<|chat|>x"]
    assert len(got[6]["ids"]) < 300


def test_ids_of_pieces_are_those_of_a_plain_loop(spark, texts):
    merges = B.bpe_learn(texts, "t", 40)
    ranks = {p: i for i, p in reversed(list(enumerate(merges)))}
    for piece in [" the", "thread", "naïve", "aaaaa", "bananabandana", "a" * 1001, "xyz"]:
        symbols = [f"{b:02X}" for b in piece.encode()]
        while found := [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]:
            _, i = min(found)
            symbols[i:i + 2] = ["".join(symbols[i:i + 2])]
        assert B.merge_symbols(piece, ranks) == symbols


def test_lowest_rank_first():
    ranks = {("61", "62"): 1, ("62", "63"): 0}
    assert B.merge_symbols("abc", ranks) == ["61", "6263"]
