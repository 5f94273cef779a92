"""Mixing, line rules, shards, pseudo-likelihood and toxicity against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
from colloquy.llm import mixing, pseudo_lm, quality, sharding, toxicity
from colloquy.llm.wordhash import chunks, hash_words
from pyspark.sql import functions as F


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


# Mixing

def seats_by_quotient(targets, limits, h):
    got = [0] * len(targets)
    for _ in range(min(h, sum(limits))):
        best = max((i for i in range(len(targets)) if got[i] < limits[i]), key=lambda i: (targets[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def test_quotas_are_the_highest_quotients(spark):
    sizes = [("a", 5000), ("b", 300), ("c", 41), ("d", 2000), (None, 900)]
    df = spark.createDataFrame(sizes, "source string, source_size long")
    mix = mixing.Mix(block_words=7, shards=5)
    targets = mixing.source_targets(df, mix).cache()
    got = {r["source"]: r for r in targets.collect()}
    total = sum(n for _, n in sizes)
    assert abs(sum(r["target"] for r in got.values()) - total) < 1e-6
    assert all(r["target"] <= 3 * r["source_size"] + 1e-9 for r in got.values())
    quotas = mixing.shard_quotas(targets, mix).collect()
    block = quotas[0]["block"]
    names = [s for s, _ in sizes]
    limits = [3 * -(-n // block) for _, n in sizes]
    for shard in range(1, 6):
        h = int(total * shard / (block * 5) + 0.5)
        want = seats_by_quotient([got[s]["target"] for s in names], limits, h)
        have = [sum(r["quota"] for r in quotas if r["source"] == s and r["shard"] <= shard) for s in names]
        assert have == want


def test_mix_comes_near_its_targets(make):
    rnd = random.Random(3)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 900])), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    first = sorted(rows_of(mixing.mix_words(make(rows)), "doc_id", "source", "size", "target", "taken"))
    assert first == sorted(rows_of(mixing.mix_words(make(rows).repartition(7)), "doc_id", "source", "size", "target", "taken"))
    for source in {r[1] for r in first}:
        own = [r for r in first if r[1] == source]
        assert abs(sum(r[4] for r in own) - own[0][3]) <= 0.02 * own[0][3] + 5
    assert all(0 <= r[4] <= 3 * r[2] for r in first)


def test_mixed_documents_are_whole(make):
    rows = [(i, f"text number {i} of the source", "a" if i % 9 else "b") for i in range(300)]
    out = mixing.mix_documents(make(rows)).collect()
    assert {(r["doc_id"], r["text"]) for r in out} <= {r[:2] for r in rows}
    share = sum(r["source"] == "b" for r in out) / len(out)
    assert share > 0.2  # 34 of 300 documents, wanted 2 of 7, at most three times


def test_texts_are_shuffled_once_on_their_way_to_the_mix(spark, make, capsys):
    rows = [(i, f"text number {i}", "a" if i % 9 else "b") for i in range(60)]
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        mixing.mix_documents(make(rows)).explain()
    finally:
        spark.conf.set(key, before)
    plan = capsys.readouterr().out
    # One exchange of the rows with their texts and one of the sums they meet.
    assert "REPARTITION" not in plan and plan.count("Exchange hashpartitioning(bucket") == 2


def test_mix_of_odd_rows(odd, empty):
    got = mixing.mix_words(odd)
    assert got.count() == odd.count()
    assert all(t == 0 for s, t in rows_of(got, "size", "taken") if s == 0)
    assert mixing.mix_words(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


# Line rules

def brute_lines(text):
    ws = (text or "").encode().split()
    tri = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    inside = {p for i, t in enumerate(tri) if tri.count(t) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))


def test_line_counts(make):
    rnd = random.Random(5)
    texts = [None, "", "a", "a a", "a a a", "a a a a", "x y z x y z", "l\nl\n\nl\n \n", "p|q <b> #"]
    texts += ["".join(rnd.choice(["a", "b ", " c", "\n", "d\t", "é|", "  ", "\r"]) for _ in range(rnd.choice([5, 60, 300]))) for _ in range(60)]
    got = rows_of(quality.judge_lines(make(list(enumerate(texts)))), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(got) == [(i, *brute_lines(t)) for i, t in enumerate(texts)]


def test_line_rules(make):
    fifty = "\n".join("Sentence " + " ".join(f"word{i}{j}" for j in range(20)) + "." for i in range(3))
    texts = {0: fifty, 1: fifty + "\nHome | About | Shop | Contact\nAll rights reserved.", 2: "\n".join(["Home | News | Top | Map"] * 9 + [f"w{i}" for i in range(40)]),
             3: "\n".join(f"BUY!! NOW!! ITEM{i}!! CHEAP!! TODAY{i}!!" for i in range(20)), 4: "too short."}
    got = {r["doc_id"]: r for r in quality.judge_lines(make(texts.items())).collect()}
    assert {i: r["kept"] for i, r in got.items()} == {0: True, 1: True, 2: False, 3: False, 4: False}
    assert got[1]["cleaned_text"] == fifty and got[4]["base_failed"]


def test_lines_of_odd_rows(odd, empty):
    assert quality.judge_lines(odd).count() == odd.count()
    assert not any(r["kept"] for r in quality.judge_lines(odd).where("text IS NULL OR trim(text) = ''").collect())
    assert quality.judge_lines(empty).count() == 0


# Shards

def least_capacity(sizes, shards):
    def fits(c):
        n, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n <= shards
    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


def check_shards(df, n_shards):
    rows = sharding.shard_documents(df, n_shards).collect()
    groups, members = {}, {}
    for r in rows:
        groups[r["digest"]] = groups.get(r["digest"], 0) + r["size"]
        members.setdefault(r["digest"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in members.values())
    order = sorted(groups)
    assert [min(members[g]) for g in order] == sorted(min(members[g]) for g in order)
    held = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(n_shards)]
    assert max(held) == least_capacity([groups[g] for g in order], n_shards)
    for k in range(n_shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots)))
    return rows, held


def test_shards_have_the_least_capacity(make, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    rnd = random.Random(1)
    rows = [(i, f"{rnd.randrange(400)} " * rnd.choice([1, 3, 40])) for i in range(600)]
    _, held = check_shards(make(rows), 5)
    assert min(held) > 0.9 * max(held)
    # One group that is larger than a shard would be.
    _, held = check_shards(make(rows + [(1000 + i, "hot " * 50) for i in range(300)]), 6)
    assert sorted(held)[-2] < 2.5 * sorted(held)[0]


def test_shards_of_odd_rows(odd, empty):
    rows, _ = check_shards(odd, 4)
    assert len(rows) == odd.count()
    raw = {hashlib.md5((r["text"] or "").encode()).hexdigest(): (r["text"] or "").encode() for r in odd.collect()}
    assert all(r["text_crc32"] == zlib.crc32(raw[r["digest"]]) and r["size"] == len(raw[r["digest"]]) + 1 for r in rows)
    assert sharding.shard_documents(empty).count() == 0


# Word hashes

def test_words_of_chunks():
    texts = ["", "a b", None, "b\n\nc ", " d", "é漢 b", "x" * 50]
    seen = {}
    for size in (1, 6, 1 << 20):
        for a, b, data, offsets in chunks(pa.array(texts).slice(0), size):
            hashes, firsts = hash_words(data, offsets)
            for i in range(a, b):
                want = (texts[i] or "").encode().split()
                got = hashes[firsts[i - a]:firsts[i - a + 1]].tolist()
                assert len(got) == len(want)
                assert all(seen.setdefault(w, h) == h for w, h in zip(want, got))
    assert len(set(seen.values())) == len(seen)


# Pseudo-likelihood

def test_network_learns_and_sums(spark, make):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["the cat sat", "a dog ran", "on the mat"]) for _ in range(200))) for i in range(40)]
    docs = make(rows + [(99, " ".join(rnd.sample(" ".join(t for _, t in rows[:3]).split(), 300)))])
    flat = pseudo_lm.train(docs)
    assert np.array_equal(flat, pseudo_lm.train(docs))
    before = dict(rows_of(pseudo_lm.score(docs, pseudo_lm.initial()), "doc_id", "mean_log_prob"))
    after = dict(rows_of(pseudo_lm.score(docs, flat), "doc_id", "mean_log_prob"))
    assert all(after[i] > before[i] + 2 for i in range(40))
    assert after[99] < min(after[i] for i in range(40))  # the same words, shuffled
    p, text = pseudo_lm.split(flat), rows[0][1]
    hashes, _ = hash_words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    ids, total = pseudo_lm.classes(hashes), 0.0
    for k, target in enumerate(ids):
        around = [ids[k + j] if 0 <= k + j < len(ids) else pseudo_lm.EDGE for j in pseudo_lm.PLACES]
        h = np.tanh(p["bias"] + sum(p["table"][j][a] for j, a in enumerate(around)))
        u, v = divmod(int(target), pseudo_lm.CODES)
        z = h @ p["upper"] + p["upper_bias"]
        y = (h + p["given"][u]) @ p["lower"] + p["lower_bias"][u]
        total += z[u] - np.log(np.exp(z).sum()) + y[v] - np.log(np.exp(y).sum())
    got = dict(rows_of(pseudo_lm.score(docs, flat), "doc_id", "log_prob"))[0]
    assert abs(got - total) < 0.01 * abs(total)


def test_scores_of_odd_rows(odd, empty):
    flat = pseudo_lm.initial()
    got = rows_of(pseudo_lm.score(odd, flat), "n_words", "log_prob", "mean_log_prob")
    assert len(got) == odd.count() and all((n == 0) == (m is None) and (n or s == 0) for n, s, m in got)
    assert pseudo_lm.score(empty, pseudo_lm.train(empty, rounds=1)).count() == 0


# Toxicity

def labelled(spark, make, n=1500, flip=False):
    rnd = random.Random(4)
    syllables = ["an", "the", "or", "in", "st", "re", "ou", "ha", "ti", "ed"]
    rows, labels = [], []
    for i in range(n):
        ws = ["".join(rnd.choice(syllables) for _ in range(rnd.choice([1, 2, 3]))) for _ in range(rnd.choice([20, 100, 400]))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(1 + len(ws) // 25):
                ws[rnd.randrange(len(ws))] = rnd.choice(["blockhead", "numskull", "dimwit", "bonehead"])
        held = zlib.crc32(str(i).encode()) % 3 == 1
        rows.append((i, " ".join(ws)))
        labels.append((i, 0, int(toxic != (flip and held))))
    return make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, make):
    docs, labels = labelled(spark, make)
    model = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, model).join(labels, "doc_id").where("held_out").collect()
    hits = sum(r["predicted"] == r["toxic"] for r in got)
    assert len(got) > 400 and hits >= 0.97 * len(got)
    assert sum(r["predicted"] and r["toxic"] for r in got) >= 0.9 * sum(r["toxic"] for r in got)
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.7) == r["predicted"] for r in got)
    # Labels of held-out rows change nothing.
    other = toxicity.train(docs, labelled(spark, make, flip=True)[1])
    assert other.threshold == model.threshold and np.array_equal(other.ratios, model.ratios)


def test_toxicity_of_odd_rows(spark, odd, empty, make):
    docs, labels = labelled(spark, make, 300)
    model = toxicity.train(docs, labels.union(labels.limit(3)).union(spark.createDataFrame([(None, 1, 1), (5, 1, None)], labels.schema)))
    got = toxicity.score_documents(odd, model).collect()
    assert len(got) == odd.count() and all(r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert toxicity.train(docs, labels.where("toxic = 0")) is None and toxicity.train(empty, labels) is None
    assert {r["score"] for r in toxicity.score_documents(odd, None).collect()} == {0.0}
    assert toxicity.score_documents(empty, model).count() == 0
