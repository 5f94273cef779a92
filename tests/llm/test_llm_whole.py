"""Operators that have to do the whole job, against brute force without their shortcuts."""

import random
from itertools import combinations

import numpy as np
import pytest
from colloquy.llm import decontaminate, pseudo_lm
from colloquy.llm.wordhash import hash_words


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


# Benchmark passages

def slid(doc, item):
    """Most equal words of any window of the item laid on the document, if enough; else 0."""
    n, size = len(item), min(decontaminate.WINDOW, len(item))
    if n < decontaminate.LEAST:
        return 0
    best = 0
    for shift in range(-n + 1, len(doc)):
        equal = [0 <= shift + q < len(doc) and doc[shift + q] == item[q] for q in range(n)]
        best = max(best, max(sum(equal[a:a + size]) for a in range(n - size + 1)))
    return best if best * decontaminate.WINDOW >= size * decontaminate.MATCHES else 0


def test_every_pattern_of_substitutions_is_found(spark, make):
    for sizes in ((9, 10, 11, 12, 13, 17), (5, 6, 7, 8)):
        items = {n: [f"i{n}w{k}" for k in range(n)] for n in sizes}
        docs = []
        for n, item in items.items():
            window = min(n, decontaminate.WINDOW)
            spare = window - -(-window * decontaminate.MATCHES // decontaminate.WINDOW)
            for most in range(spare + 2):
                patterns = list(combinations(range(window), most))
                for spots in patterns if most <= spare else patterns[::7]:
                    docs.append(["a"] * (len(docs) % 3) + ["x" if k in spots else w for k, w in enumerate(item)][:window])
        bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
        got = dict(rows_of(decontaminate.contamination(make([(i, " ".join(d)) for i, d in enumerate(docs)]), bench), "doc_id", "best_overlap"))
        assert got == {i: max(slid(d, x) for x in items.values()) for i, d in enumerate(docs)}


def test_passages_as_by_sliding(spark, make):
    rnd = random.Random(4)
    items = [[f"w{rnd.randrange(9)}" for _ in range(n)] for n in (4, 5, 7, 8, 9, 10, 12, 13, 14, 25)]
    docs = [[f"w{rnd.randrange(9)}" for _ in range(rnd.choice([0, 3, 6, 20, 90]))] for _ in range(120)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = rows_of(decontaminate.contamination(make([(i, " ".join(d)) for i, d in enumerate(docs)]), bench), "doc_id", "n_items", "best_overlap")
    want = [[slid(d, x) for x in items] for d in docs]
    assert sorted(got) == [(i, sum(b > 0 for b in row), max(row)) for i, row in enumerate(want)]


# Pseudo-likelihood

def one_class(n):
    """Words of one class, found by trying."""
    found = {}
    for i in range(40_000):
        word = f"v{i}".encode()
        c = int(pseudo_lm.classes(hash_words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0])[0])
        found.setdefault(c, []).append(word.decode())
        if len(found[c]) == n:
            return found[c]


@pytest.mark.parametrize("head", [1 << 19, 2])
def test_words_of_one_class_have_their_own_probability(spark, make, monkeypatch, head):
    monkeypatch.setattr(pseudo_lm, "HEAD", head)
    often, some, once = one_class(3)
    docs = make([(1, f"a b {often} c d"), (2, f"a b {some} c d"), (3, f"a b {once} c d"), (4, f"{often} " * 5), (5, f"{some} e"),
                 (6, None), (2, f"a b {some} c d")])
    got = {r[0]: r[1] for r in rows_of(pseudo_lm.score(docs, pseudo_lm.initial()), "doc_id", "log_prob")}
    # Six times, three times and once in the corpus; equal contexts and equal class.
    assert abs(got[1] - got[2] - np.log(6 / 3)) < 3e-4 and abs(got[2] - got[3] - np.log(3)) < 3e-4
    assert got[6] == 0


def test_vocabulary_grows_and_all_words_are_trained():
    assert pseudo_lm.codes_for(8) == 32 and pseudo_lm.codes_for(10**8) == 100
    assert all(pseudo_lm.codes_of(pseudo_lm.initial(codes=c)) == c for c in (32, 33, 57, 100))
    hashes = np.arange(1000, dtype=np.uint64)
    seen = np.concatenate([pseudo_lm._masked(hashes, 1000, turn) for turn in range(pseudo_lm.ROUNDS)])
    assert sorted(seen) == list(range(1000))
