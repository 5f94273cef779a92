"""Splits, sinks and synthesized messages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from colloquy.functions import fixed_values as V
from colloquy.functions import render as R
from colloquy.operators import dialogues as D
from colloquy.operators import ranking, scan, synth, traces
from colloquy.operators.packing import pack_blocks
from colloquy.operators.splits import prefix_split, shuffled_split
from colloquy.operators.templates import expand
from colloquy.plans.on_synth import GAME
from colloquy.session import scratch_path
from colloquy.sources import files, fingerprint, mix, sinks


def test_splits_cover_and_do_not_meet(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    for out in (prefix_split(df, ["k"]), shuffled_split(df, "k", "s", {"side": F.lit(8)})):
        sides = {}
        for r in out.collect():
            sides.setdefault(r["side"], set()).add(r["k"])
        assert sides["train"] | sides["val"] == set(range(101)) and not sides["train"] & sides["val"]
    assert [r["side"] for r in prefix_split(spark.range(1).withColumnRenamed("id", "k"), ["k"]).collect()] == ["train"]


def test_dialogue_filters(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "a"), (2, 1, "x", "b"), (2, 2, "y", "c"),
             (3, 0, "user", "a"), (3, 1, "user", "b"), (3, 2, "bot", "c"), (4, 0, "user", "a"), (4, 1, "bot", ""),
             (5, 0, "user", "a"), (5, 1, "bot", "z" * 320), (6, 0, "user", "a"), (6, 1, "bot", "z" * 321), (6, 2, "user", "c")]
    d = D.dialogues(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string"))
    assert [r["conv_id"] for r in D.two_speakers(d, 320).collect()] == [5]
    assert sorted(r["conv_id"] for r in D.drop_long_turns(d, 320).collect()) == [2, 3, 5, 6]
    rows = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    assert {r["conv_id"] for r in D.two_speaker_turns(rows, 320).collect()} == {5}


@pytest.mark.parametrize("chars", [1, 25, 2048])
def test_parts_in_order_are_the_rendered_dialogue(spark, monkeypatch, chars):
    monkeypatch.setattr(scan, "HOT_ROWS", 20 if chars == 25 else scan.HOT_ROWS)
    turns = [(c, i * 2, "user" if i % 2 == 0 else "bot", f"turn {i}") for c, n in ((1, 4), (2, 5), (3, 70), (4, 1)) for i in range(n)]
    rows = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string").repartition(3)
    whole = {r["conv_id"]: (r["d"], r["c"]) for r in D.dialogues(rows).select(
        "conv_id", R.render_dialogue(F.col("turns.text")).alias("d"), R.render_tagged_chat(F.col("turns.text")).alias("c")).collect()}
    parts = D.fragments(rows, chars).select("conv_id", "part", "n", "turns", D.part_lines("", f"{V.DIALOG_SEP}\n").alias("d"),
                                            D.part_lines(f"{V.CHAT}\n", f"{V.END}\n").alias("c")).orderBy("conv_id", "part").collect()
    lines = D.rendered_lines(rows).orderBy("conv_id", "turn").collect()
    for c, (d, chat) in whole.items():
        assert "".join(r["line"] for r in lines if r["conv_id"] == c) == d
        mine = [r for r in parts if r["conv_id"] == c]
        assert ("".join(r["d"] for r in mine), "".join(r["c"] for r in mine)) == (d, chat)
        assert sum(len(r["turns"]) for r in mine) == mine[0]["n"]
    assert all(sum(len(u["text"]) + 1 for u in r["turns"][:-1]) < chars for r in parts)


def test_dialogues_held_as_two_arrays(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["x", "y", "x"]), (2, ["a"], ["x", "y"]), (3, [], []), (4, None, ["x"])],
                               "id int, dialogue array<string>, speakers array<string>")
    got = [tuple(r) for r in D.turns_of(df, "id", "dialogue", "speakers").orderBy("conv_id", "turn").collect()]
    assert got == [(1, 0, "x", "a"), (1, 1, "y", "b"), (1, 2, "x", "c"), (2, 0, "x", "a"), (2, 1, "y", None)]


def test_a_conversation_of_a_million_turns(spark):
    """No part is larger than its limit; packing takes the parts as they are."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("bot").alias("role"),
                                 F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    parts = D.fragments(rows).select("conv_id", "part", "n", "turns", D.part_lines("", "#\n").alias("doc")).cache()
    size = parts.agg(F.max(F.length("doc")), F.sum(F.size("turns")), F.sum(F.length("doc")), F.count_if(D.last_part())).first()
    chars = sum(len(f"A: t{i}\n") for i in range(n)) + 2
    assert size[0] <= 2 * D.FRAGMENT_CHARS and tuple(size)[1:] == (n, chars, 1)
    ids = parts.select("part", "n", "turns", F.transform(F.split("doc", ""), lambda c: F.ascii(c)).alias("ids"))
    blocks = pack_blocks(ids, ["part"], "ids", 300, 4096, ends=D.last_part())
    got = blocks.agg(F.count(F.lit(1)), F.min(F.size("ids")), F.max("block_no")).first()
    assert tuple(got) == ((chars + 1) // 4096, 4096, (chars + 1) // 4096 - 1)
    parts.unpersist()


def test_keyed_output(spark):
    root, suffix = scratch_path(spark, "k"), "!"

    def build(n=3):
        return spark.range(n).select(F.transform(F.array("id"), lambda x: x + 1).alias("v"))

    def render(x):
        return x + suffix + V.CHAT

    def also(x):
        return render(x) + R.DIGITS if hasattr(R, "DIGITS") else render(x)
    path, reused = sinks.keyed_output(spark, root, {"a": 1}, build, code=[also])
    assert not reused and sinks.keyed_output(spark, root, {"a": 1}, build, code=[also]) == (path, True)
    assert spark.read.parquet(f"{path}/data").count() == 3
    with pytest.raises(FileNotFoundError):
        sinks.keyed_output(spark, root, {"a": 2}, build, cached_only=True)
    others = [sinks.keyed_output(spark, root, {"a": 1}, lambda: build(4), code=[also])]
    others.append(sinks.keyed_output(spark, root, {"a": 1}, lambda: build().select(F.transform("v", lambda x: x + 2).alias("v")), code=[also]))
    others.append(sinks.keyed_output(spark, root, {"a": 1}, build, code=[also], vocabulary=[("61", "62")]))
    suffix = "?"  # a value the renderer closes over, two functions down
    others.append(sinks.keyed_output(spark, root, {"a": 1}, build, code=[also]))
    suffix = "!"
    assert len({path, *[p for p, _ in others]}) == 5 and not any(r for _, r in others)
    assert sinks.keyed_output(spark, root, {"a": 1}, build, code=[also]) == (path, True)


def test_fingerprints_see_code_and_named_values(monkeypatch):
    def make(body):
        space = {"__name__": "made", "LIMIT": 5, "PATTERN": re.compile("a+")}
        exec(body, space)
        return space["render"], space
    first, space = make("def helper(x):\n    return x + LIMIT\ndef render(x):\n    return helper(x) if PATTERN else [helper(y) for y in x]")
    before = fingerprint.function_print(first)
    assert fingerprint.function_print(first) == before
    for name, value in (("LIMIT", 6), ("PATTERN", re.compile("a+", re.I)), ("helper", lambda x: x)):
        old, space[name] = space[name], value
        assert fingerprint.function_print(first) != before, name
        space[name] = old
    other, _ = make("def helper(x):\n    return x - LIMIT\ndef render(x):\n    return helper(x) if PATTERN else [helper(y) for y in x]")
    assert fingerprint.function_print(other) != before


def test_one_bad_source_does_not_stop_the_rest(spark, tmp_path):
    spark.range(4).write.parquet(f"{tmp_path}/good")
    (tmp_path / "good2").mkdir()
    (tmp_path / "good2" / "x.parquet").write_bytes(b"no parquet")
    sources = {"missing": lambda: spark.read.parquet(f"{tmp_path}/none"), "good": lambda: spark.read.parquet(f"{tmp_path}/good"),
               "damaged": lambda: spark.read.schema("id bigint").parquet(f"{tmp_path}/good2"),
               "other columns": lambda: spark.range(2).withColumnRenamed("id", "x"),
               "fails late": lambda: spark.range(3).select(F.raise_error(F.lit("late")).cast("bigint").alias("id")),
               "own fault": lambda: 1 / 0}
    rows, errors = mix.gather(spark, sources)
    assert sorted(tuple(r) for r in rows.collect()) == [(i, "good") for i in range(4)]
    got = {r["source"]: (r["stage"], r["error"]) for r in errors.collect()}
    assert {k: s for k, (s, _) in got.items()} == {"missing": "open", "damaged": "read", "other columns": "schema", "fails late": "read", "own fault": "open"}
    assert "ZeroDivisionError" in got["own fault"][1]
    with pytest.raises(RuntimeError, match="no source"):
        mix.gather(spark, {"own fault": sources["own fault"]})


def test_files_with_invalid_bytes(spark, tmp_path):
    for name, body in (("a.py", b"ok \xc3\xa9"), ("b.py", b"x\xff\xfe y\xc3(z"), ("d.py", "keeps \ufffd".encode())):
        (tmp_path / name).write_bytes(body)
    got = {r["path"]: (r["text"], r["valid"]) for r in files.scan_source_files(spark, str(tmp_path)).collect()}
    want = {n: (tmp_path / n).read_bytes().decode(errors="ignore") for n in ("a.py", "b.py", "d.py")}
    assert got == {n: (t, n != "b.py") for n, t in want.items()}


def test_action_targets(spark):
    df = spark.createDataFrame([([5, 9, 5, 9, 1], 3), ([5, 5], 3), ([9], None)], "ids array<int>, a int")
    got = [r["y"] for r in df.select(sinks.action_targets(F.col("ids"), 9, F.col("a")).alias("y")).collect()]
    assert got == [[-1, -1, -1, 3, -1], [-1, -1], [-1]]


def test_source_tree(spark, tmp_path):
    tree = tmp_path / "tree"
    for name, body in (("py/a.py", "x"), ("py/build/b.py", "x"), ("docs/c.py", "x"), ("py/d.txt", "x"),
                       ("py/e.py", "x" * 50), ("py/f.MJS", "x"), ("py/g.mjs", "y")):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(body)
    got = files.scan_source_files(spark, str(tree), subdirs=["py"], max_bytes=40)
    assert sorted(r["path"] for r in got.collect()) == ["py/a.py", "py/f.MJS", "py/g.mjs"]


def test_chat_xml(spark, tmp_path):
    (tmp_path / "room1.xml").write_text(
        '<Session><Posts><Post class="Greet" pos="0">hi  10-19-20sUser7</Post><Post pos="1"></Post></Posts></Session>')
    got = files.read_chat_xml(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["session"], r["act"], r["text"]) for r in got] == [("room1", "Greet", "hi friend"), ("room1", "Other", "")]


def test_nul_blob(spark, tmp_path):
    (tmp_path / "blob.txt").write_bytes(b"a/b.py\nx = 1\ny\0\0lib/c.rs\nfn\0")
    got = files.read_nul_blob(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r["path"], r["lang"], r["text"]) for r in got] == [("a/b.py", "python", "x = 1\ny"), ("lib/c.rs", None, "fn")]


def test_empty_source_is_an_error(spark):
    rows = spark.createDataFrame([("a",)], "source string")
    names = spark.createDataFrame([("a",), ("b",)], "source string")
    with pytest.raises(RuntimeError, match="b"):
        mix.assert_not_empty(rows, names)


def test_trace_filters(spark):
    good = ("q " * 10, "step " * 12, "7")
    data = [good, ("", good[1], "7"), ("q" * 601, good[1], "7"), (good[0], "short", "7"), (good[0], good[1], ""),
            (good[0], good[1], "z" * 121), (good[0], "s" * 1200, "7")]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "doc_id int, question string, think string, answer string")
    df = df.withColumn("identity", F.col("question"))
    assert [r["doc_id"] for r in traces.clean_traces(df).collect()] == [0]


def test_expand_only_named_slots(spark):
    rows = spark.createDataFrame([(1, "cat")], "id int, pic string")
    got = expand(rows, ["a {pic}", "b {it}", "c {pic} {it}", "d", "e {other}"],
                 {"pic": F.col("pic"), "it": F.array(F.lit("x"), F.lit("y"))})
    assert sorted(r["text"] for r in got.collect()) == ["a cat", "b x", "b y", "c cat x", "c cat y", "d"]


def test_template_phrases():
    assert synth.template_phrases(["a {x} {y}", "b"], {"x": ["1", "2"], "y": ["3"]}) == [
        ("a {x} {y}", "a 1 3"), ("a {x} {y}", "a 2 3"), ("b", "b")]
    assert all("{" not in p for _, p in GAME)


def test_states_never_hold_held_scores(spark):
    df = spark.range(3000).select(F.col("id"), synth.state_fields(F.col("id"), False)["score"].alias("s"),
                                  synth.state_fields(F.col("id"), True)["score"].alias("t"))
    got = df.agg(F.collect_set("s").alias("s"), F.collect_set("t").alias("t")).first()
    held = {str(s) for s in V.HOLDOUT_SCORES}
    assert not held & set(got["s"]) and held <= set(got["t"])


def test_labelled_corpus(spark):
    rows = [("chat", f"{i:03d}", i % 5 == 0, f"Text {i % 40}") for i in range(100)] + [
        ("code", f"{i:03d}", i % 2 == 0, "  ") for i in range(4)]
    df = spark.createDataFrame(rows, "label string, place string, held_out boolean, text string")
    out = synth.labelled_corpus(df, {"chat": 12, "code": 12}, 3).collect()
    texts = [r["text"].lower() for r in out]
    assert len(set(texts)) == len(texts) and sum(r["held_out"] for r in out) == 3 and len(out) == 15
    with pytest.raises(RuntimeError, match="code"):
        synth.assert_both_sides(spark.createDataFrame([("chat", True), ("chat", False)], "label string, held_out boolean"),
                                ["chat", "code"])


def test_topk_keeps_ties_and_nucleus_keeps_the_crossing_item(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([5.0, 4.0, 4.0, 4.0, 1.0])], "g string, i int, s double")
    assert sorted(r["i"] for r in ranking.topk_filter(df, ["g"], "s", 2).collect()) == [0, 1, 2, 3]
    p = spark.createDataFrame([("g", 0, 0.95), ("g", 1, 0.05), ("h", 0, 0.4), ("h", 1, 0.3), ("h", 2, 0.3)], "g string, i int, p double")
    kept = {(r["g"], r["i"]) for r in ranking.nucleus_filter(p, ["g"], "i", "p", 0.5).collect()}
    assert kept == {("g", 0), ("h", 0), ("h", 1)}


def test_labelled_corpus_of_rows_that_share_places_and_texts(spark):
    rng = random.Random(3)
    rows = [("chat" if i % 3 else "code", f"{rng.randrange(40):032x}", i % 4 == 0, f"Text {rng.randrange(60)}") for i in range(200)]
    df = spark.createDataFrame(rows, "label string, place string, held_out boolean, text string").repartition(5)
    first = {}
    for label, place, _, text in rows:
        first[label, text.lower()] = min(place, first.get((label, text.lower()), place))
    want = [r for r in rows if r[1] in set(first.values())]
    whole = synth.labelled_corpus(df, {"chat": 1000, "code": 1000}, 1000).collect()
    assert sorted((r["label"], r["place"], r["held_out"], r["text"]) for r in whole) == sorted(want)
    some = synth.labelled_corpus(df, {"chat": 12, "code": 9}, 2).collect()
    for label, held, n in (("chat", False, 12), ("chat", True, 2), ("code", False, 9), ("code", True, 2)):
        places = sorted(p for k, p, h, _ in want if (k, h) == (label, held))[:n]
        assert sorted(r["place"] for r in some if (r["label"], r["held_out"]) == (label, held)) == places
