"""The prefix trie and the repair of conversations against plain loops."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from colloquy.llm import repair, trie
from colloquy.operators import scan
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def crc(text):
    return zlib.crc32(text.encode())


def by_order(rows, digest):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        out[c].append((turn is not None, turn or 0, role, digest(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    return {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in out.items()}


def brute_trie(rows):
    told = by_order([(c, t, r or "", x or "") for c, t, r, x in rows if c is not None], hashlib.md5)
    made = {}
    for c, turns in told.items():
        h = crc(str(c)) % 6
        first = int(c - (abs(c) % 100) * (1 if c >= 0 else -1))
        made[c] = tuple(told.get(first, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in made.items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)

    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        own = (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        saved[k] = own + sum(saved[x] for x in children[k])
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


def trie_of(df, **options):
    return sorted(tuple(r) for r in trie.prefix_trie(df, **options).collect())


def chats(seed, n=60, most=9):
    """Conversations with few texts, so that openings are shared and rows recur."""
    draw = random.Random(seed)
    rows = []
    for c in [*range(n), -7, -200, 100, 101, 140, 900, 987]:
        for t in range(draw.randint(1, most)):
            turn = None if draw.random() < 0.05 else t if draw.random() < 0.9 else max(0, t - 1)
            role = draw.choice(["user", "assistant", "system", "user", "assistant", None, "", "other"])
            text = draw.choice(["a.", "bb!", "c", "dd dd.", "", None, " \n", "é漢😀?", "a."])
            rows += [(c, turn, role, text)] * (2 if draw.random() < 0.05 else 1)
    rows += [(None, 1, "user", "x"), (None, None, "user", "x.")]
    return rows


ODD = ["cid", "pos", "copy", "node", "label", "conv", "at", "depth", "ka", "digest", "fault", "a.b", "n_convs", "cost"]


def with_odd_columns(df):
    for name in ODD:
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.mark.parametrize("band,hot", [(2, None), (16, 7)])
def test_trie_equals_a_loop(spark, monkeypatch, band, hot):
    if hot:
        monkeypatch.setattr(scan, "HOT_ROWS", hot)
    rows = chats(band)
    df = with_odd_columns(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert trie_of(df, band=band) == brute_trie(rows)


def test_trie_of_long_conversations(spark):
    rows = [(c, t, "user", f"t{t % 3}" if t < cut else f"own{c}") for c, n, cut in
            ((0, 90, 80), (1, 90, 70), (3, 40, 40), (200, 1, 1), (250, 3, 2)) for t in range(n)]
    rows.append((5, 0, "user", "long " * 200_000))
    assert trie_of(spark.createDataFrame(rows, SCHEMA), band=3) == brute_trie(rows)


def test_ends_over_several_blocks(spark):
    ids = [k * 40_000 for k in range(9)] + [1, 2, -70_000]
    rows = [(c, t, "user", "same") for c in ids for t in range(6)]
    assert trie_of(spark.createDataFrame(rows, SCHEMA)) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_of(spark.createDataFrame([], SCHEMA)) == []
    assert trie_of(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []


# Repair

def cheapest(rows):
    """(cost, audit, lines) of rows (role, text, fault), over all walks."""
    def less(a, b):
        return b if a is None or (b is not None and b[:2] < a[:2]) else a

    def add(walk, cost, letter, line=None):
        return walk and (walk[0] + cost, walk[1] + letter, walk[2] + ([line] if line is not None else []))

    def inserts(w):
        for _ in range(3):
            for s, to, role in ((0, 2, "user"), (1, 2, "user"), (3, 2, "user"), (2, 3, "assistant")):
                w[to] = less(w[to], add(w[s], 3, "I", f"{role}:"))
        return w
    walks = inserts([(0, "", []), None, None, None])
    for role, text, fault in rows:
        new = [add(w, 4, "D") for w in walks]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            for s, to, initial in ((0, 1, "s"), (0, 2, "u"), (1, 2, "u"), (3, 2, "u"), (2, 3, "a")):
                if role[:1] == initial:
                    new[to] = less(new[to], add(walks[s], more, "K", f"{role}:{text}"))
                if initial != "s":
                    due = "user" if initial == "u" else "assistant"
                    new[to] = less(new[to], add(walks[s], 3 + more, "R", f"{due}:{text}"))
        walks = inserts(new)
    return less(walks[0], walks[3])


def brute_repair(rows):
    spaces = " \t\n\x0b\x0c\r"
    after, first = [], {}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc(f"{' ' if c is None else c}:{' ' if turn is None else turn}") % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        after += [(c, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        first[c] = []
    told = by_order(after, hashlib.sha256)
    out = []
    for c in first:
        seen, faults = set(), []
        for role, text in told.get(c, []):
            bare = text.rstrip(spaces)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        said = told.get(c, [])
        turns = [t for k, t, _, _ in after if k == c and t is not None]
        cost, audit, lines = cheapest([(r, t, f) for (r, t), f in zip(said, faults)])
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"),
                    faults.count("duplicate"), faults.count("truncated"),
                    sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def repaired(df, **options):
    return sorted((tuple(r) for r in repair.repair_conversations(df, **options).collect()), key=repr)


@pytest.mark.parametrize("fan,hot", [(2, None), (4096, 7)])
def test_repair_equals_a_loop(spark, monkeypatch, fan, hot):
    if hot:
        monkeypatch.setattr(scan, "HOT_ROWS", hot)
    rows = chats(fan + 100, n=80, most=14)
    df = with_odd_columns(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert repaired(df, fan=fan) == brute_repair(rows)


def test_repair_of_long_conversations(spark):
    """Audits of more letters than ranks are numbers for, over blocks of blocks."""
    draw = random.Random(5)
    rows = [(c, t, draw.choice(["user", "assistant", "assistant", "system"]), f"{draw.choice('abc')} {t if c else t % 90}" + draw.choice(["", ".", "."]))
            for c, n in ((0, 150), (1, 75), (2, 40), (3, 16)) for t in range(n)]
    rows.append((4, 0, "user", "long " * 200_000 + "."))
    assert repaired(spark.createDataFrame(rows, SCHEMA), fan=4) == brute_repair(rows)


def test_ties_take_the_audit_that_sorts_first(spark):
    # Two assistants: a user's turn before or after, or the second one deleted and so on.
    cases = {1: ["assistant"], 2: ["user"], 3: ["user", "user"], 4: ["assistant", "user"], 5: ["system"], 6: ["system", "system", "user"],
             7: ["other"] * 3, 8: ["user", "assistant", "assistant", "user"]}
    rows = [(c, p, 4 if r == "gone" else {"s": 0, "u": 1, "a": 2}.get(r[0], 3)) for c, roles in cases.items() for p, r in enumerate(roles)]
    df = spark.createDataFrame([(f"s{c}", p, k) for c, p, k in rows], "cid string, pos bigint, code int").withColumn("code", F.col("code").cast("tinyint"))
    edits, costs = repair.repair_plan(df)
    audits = defaultdict(str)
    for r in edits.orderBy("cid", "at").collect():
        audits[int(r["cid"][1:])] += repair.LABELS[r["label"] - 1]
    cost = {int(r["cid"][1:]): r["cost"] for r in costs.collect()}
    for c, roles in cases.items():
        want = cheapest([(r, "x.", "") for r in roles])
        assert (cost[c], audits[c]) == want[:2], (c, roles)


def test_repair_of_nothing_and_of_rows_that_all_go(spark):
    assert repaired(spark.createDataFrame([], SCHEMA)) == []
    dropped = next(k for k in range(1000) if crc(f"{k}:0") % 20 == 0)
    rows = [(dropped, 0, "user", "a."), (None, None, None, None), (5, 1, "user", ""), (5, 2, "user", " ")]
    assert repaired(spark.createDataFrame(rows, SCHEMA)) == brute_repair(rows)
    assert repaired(spark.createDataFrame(rows[:1], SCHEMA)) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
