"""Repeated passages, near copies, benchmark passages, archives and pages against brute force."""

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from colloquy.llm import decontaminate, layout, neardup, pages, substring, warc
from pyspark.sql import functions as F


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


# Repeated passages

def brute_repeats(rows):
    least = {}
    for i, text in rows:
        ws = (text or "").encode().split()
        if i is not None:
            for k in range(len(ws) - 12):
                g = tuple(ws[k:k + 13])
                least[g] = min(least.get(g, i), i)
    out = []
    for i, text in rows:
        ws = (text or "").encode().split()
        gone = set()
        if i is not None:
            for k in range(len(ws) - 12):
                if least[tuple(ws[k:k + 13])] < i:
                    gone |= set(range(k, k + 13))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeating(seed, n, vocabulary):
    """Texts that share passages, have runs of one word and repeat themselves."""
    rnd = random.Random(seed)
    pool = [[rnd.choice(vocabulary) for _ in range(rnd.choice([12, 13, 14, 30, 80]))] for _ in range(8)]
    rows = []
    for i in range(n):
        ws = []
        for _ in range(rnd.choice([0, 1, 4, 9])):
            kind = rnd.random()
            if kind < 0.4:
                p = rnd.choice(pool)
                a = rnd.randrange(len(p))
                ws += p[a:] if rnd.random() < 0.5 else p[:a]
            elif kind < 0.5:
                ws += [rnd.choice(vocabulary)] * rnd.choice([3, 13, 40])
            else:
                ws += [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 12, 25]))]
        rows.append((rnd.randrange(10_000) - 100, " ".join(ws)))
    return list({i: (i, t) for i, t in rows}.values())


@pytest.mark.parametrize("seed,words", [(1, 3), (2, 40), (3, 4000)])
def test_repeats(make, seed, words):
    rows = repeating(seed, 120, [f"w{k}" for k in range(words)])
    got = rows_of(substring.remove_repeats(make(rows).repartition(5)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(got, key=repr) == brute_repeats(rows)


def test_repeats_of_odd_rows(odd, empty):
    rows = rows_of(odd, "doc_id", "text")
    got = rows_of(substring.remove_repeats(odd), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(got, key=repr) == brute_repeats(rows)
    assert substring.remove_repeats(empty).count() == 0


def test_sorted_stretches_in_any_batches():
    """Settling does not depend on how rows come in batches."""
    rnd = np.random.default_rng(1)
    table = sorted({(int(k), int(w), int(d)) for k, w, d in zip(rnd.integers(0, 40, 900), rnd.integers(0, 3, 900), rnd.integers(0, 9, 900))})
    cols = [np.array(c, np.int64) for c in zip(*table)] + [np.arange(len(table))]

    def run(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[a:a + size]) for c in cols], ["key", "whole", "doc_id", "place"])
                   for a in range(0, len(table), size)]
        out = [r for b in substring._settle_batches(iter(batches)) for r in zip(*[c.to_pylist() for c in b.columns])]
        return sorted((p, look) for _, p, look in out)
    want = run(len(table))
    # The first of each stretch is looked at where its key has several stretches and documents.
    inner = {k for k, _, _ in table} - {table[0][0], table[-1][0]}
    for k in inner:
        own = [(i, r) for i, r in enumerate(table) if r[0] == k]
        several = len({r[1] for _, r in own}) > 1 and len({r[2] for _, r in own}) > 1
        for i, r in own:
            first = min(x[2] for _, x in own if x[1] == r[1])
            assert ((i, False) in want) == (r[2] > first) and ((i, True) in want) == (several and r[2] == first)
    for size in (1, 2, 7, 100):
        assert run(size) == want


# Near copies

def brute_components(rows):
    def of(text):
        low = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        return {tuple(low[k:k + 5]) for k in range(len(low) - 4)} if len(low) >= 5 else ({tuple(low)} if low else set())
    sets = [of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def near_copies(seed, n, edits):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([4, 30, 150]))] for _ in range(6)]
    rows = []
    for i in range(n):
        ws = list(rnd.choice(base))
        for _ in range(rnd.choice(edits)):
            ws[rnd.randrange(len(ws))] = rnd.choice([f"v{rnd.randrange(3000)}", "The", "the"])
        rows.append((rnd.randrange(100_000), " ".join(ws)))
    return list({i: (i, t) for i, t in rows}.values())


def test_components(make):
    rows = near_copies(7, 250, [0, 1, 2, 3, 4, 6])
    got = rows_of(neardup.near_duplicates(make(rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(got, key=repr) == brute_components(rows)


def far_copies(seed, families, far):
    """Copies of a text too far from it to be linked, and copies of those, whole, cut and edited."""
    rnd = random.Random(seed)

    def edited(ws, n):
        ws = list(ws)
        for i in rnd.sample(range(len(ws)), n):
            ws[i] = f"v{rnd.randrange(200)}"
        return ws
    texts = []
    for _ in range(families):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([90, 160]))]
        texts += [edited(base, rnd.randrange(3)) for _ in range(12)] + [base[:n] for n in (60, 65, 70, 85)]
        for _ in range(far):
            copy = edited(base, len(base) // 12 + rnd.randrange(5))
            texts += [copy] + [edited(copy, rnd.randrange(4)) for _ in range(rnd.randrange(4))]
    rnd.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_links_far_from_the_centre(make):
    rows = far_copies(11, 5, 25)
    got = rows_of(neardup.near_duplicates(make(rows)), "doc_id", "n_shingles", "component_id", "kept")
    want = brute_components(rows)
    assert len({r[2] for r in want}) > 40  # most far copies stay apart, with their own copies
    assert sorted(got, key=repr) == want


def test_sharing_finds_every_link_between_components(spark):
    rnd = np.random.default_rng(5)
    base = rnd.integers(1, 2**62, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([rnd.permutation(base)[:rnd.integers(100, 200)],
                                      rnd.integers(1, 60, rnd.integers(1, 60)).astype(np.uint64)])) for _ in range(120)]
    own = [int(np.floor(np.log(len(s)) / np.log(neardup.GROW))) for s in sets]
    nodes = [(bytes([i]), i, bytes([i % 7]), len(s), own[i], sorted(set(own))) for i, s in enumerate(sets)]
    members = spark.createDataFrame(nodes, "node binary, id long, root binary, n long, own int, others array<int>")
    blobs = spark.createDataFrame([(bytes([i]), s.view(np.int64).tolist()) for i, s in enumerate(sets)],
                                  "node binary, elements array<long>")
    for pct in (60, 75, 90):
        got = {tuple(r) for r in neardup._sharing(neardup._first_shingles(members, blobs, pct), pct).collect()}
        want = set()
        for x in range(len(sets)):
            for y in range(x + 1, len(sets)):
                same = len(np.intersect1d(sets[x], sets[y]))
                if x % 7 != y % 7 and 100 * same >= pct * (len(sets[x]) + len(sets[y]) - same):
                    want.add((x, y))
        assert want <= got and (pct == 90 or want)


def test_components_of_odd_rows(odd, empty):
    got = rows_of(neardup.near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept")
    want = brute_components(rows_of(odd, "doc_id", "text"))
    assert sorted((r[:3] for r in got if r[0] is not None), key=repr) == [r[:3] for r in want if r[0] is not None]
    assert len(got) == len(want) and all(r[3] == (r[0] == r[2]) for r in got)
    assert neardup.near_duplicates(empty).count() == 0


def test_sketches_fill_and_agree():
    rnd = np.random.default_rng(0)
    shared, own = rnd.integers(0, 2**63, 600).astype(np.uint64), rnd.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.concatenate([shared, own[:200]]), np.concatenate([shared, own[200:]])
    rows = neardup.sketches([a, b, a[:1], a[:3]])
    assert (rows != neardup.FULL).all()
    assert abs((rows[0] == rows[1]).mean() - 0.6) < 0.15
    assert (rows[0] == neardup.sketches([a[::-1].copy()])[0]).all()


# Benchmark passages

def test_masks_find_any_two_substitutions():
    from itertools import combinations
    for spots in combinations(range(decontaminate.WINDOW), 2):
        assert any(all(k + p not in spots for p, c in enumerate(m) if c == "1")
                   for m in decontaminate.MASKS for k in range(decontaminate.WINDOW - len(m) + 1))


def test_contamination(spark, make):
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(5000)}"
    items = [[word() for _ in range(n)] for n in (14, 30, 60, 9, 4)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(None, None), (7, "")], "item_id long, text string")
    fill = lambda n: [word() for _ in range(n)]
    docs, want = [], {}

    def add(ws, hit):
        want[len(docs)] = hit
        docs.append((len(docs), " ".join(ws)))
    for x in items[:3]:
        add(fill(50) + x + fill(9), True)
        add(x, True)
        changed = list(x)
        for k in rnd.sample(range(len(x)), 1 if len(x) < 20 else 3):
            changed[k] = "other"
        add(fill(3) + changed, True)
        add(fill(7) + [w.upper() + "," for w in x], True)
    add(fill(20) + items[1][3:17] + fill(30), True)          # part of an item
    add(fill(20) + items[1][:6] + fill(30) + items[1][10:15], False)
    add(items[3], True)
    add(items[4], False)                                     # too short to be evidence
    add(fill(400), False)
    add([], False)
    got = rows_of(decontaminate.contamination(make(docs), bench), "doc_id", "contaminated", "n_items")
    assert {i: c for i, c, _ in got} == want
    assert all((n > 0) == c for _, c, n in got)


def test_a_benchmark_too_large_to_send_and_a_coarse_sieve_change_nothing(spark, sf, monkeypatch):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    names = ("doc_id", "n_items", "best_overlap")
    want = rows_of(decontaminate.contamination(read("documents"), read("benchmark")), *names)
    monkeypatch.setattr(decontaminate, "SENT_ROWS", 0)
    monkeypatch.setattr(decontaminate, "MOST_LONGS", 2)
    assert sorted(rows_of(decontaminate.contamination(read("documents"), read("benchmark")), *names)) == sorted(want)


def test_contamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "same text here " * 6), (2, None)], "item_id long, text string")
    got = decontaminate.contamination(odd, bench)
    assert got.count() == odd.count() and {r[0] for r in rows_of(got.where("contaminated"), "doc_id")} == {-3, 12}
    assert decontaminate.contamination(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


# Archives

@pytest.fixture(scope="module")
def web(spark):
    rows = [(1, "http://a/ b", "<p>x</p>"), (2, "http://a/2", None), (3, None, ""), (4, "http://a/4", "<p>x</p>"), (9, "u", "<p>x</p>"),
            (None, "http://n", "<p>x</p>"), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 9000), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 9000), (6, "u", "z" * 3_000_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("x")).withColumn("n", F.lit(1))


def test_archives_round_trip(spark, web, monkeypatch):
    got = warc.read_archives(warc.write_archives(web)).collect()
    assert len(got) == 9 and all(r["problem"] is None for r in got)
    texts = {r["page_id"]: r["html"] or "" for r in web.collect()}
    for r in got:
        raw = texts[r["page_id"]].encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == warc.digest(raw)
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == raw
    kinds = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] is not None)
    assert kinds == [(1, "revisit", 9), (2, "revisit", 3), (3, "response", None), (4, "revisit", 9), (5, "response", None),
                     (5, "response", None), (6, "response", None), (9, "response", None)]
    assert warc.read_archives(warc.write_archives(web.limit(0))).count() == 0


def test_one_member_per_record(spark, web):
    manifest = warc.write_archives(web.coalesce(1)).collect()
    assert sum(m["records"] for m in manifest) == 9
    data, members = open(manifest[0]["path"], "rb").read(), 0
    while data:
        unpack = zlib.decompressobj(31)
        record = unpack.decompress(data)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        data, members = unpack.unused_data, members + 1
    assert members == manifest[0]["records"]


def read_all(data):
    """(page_id or None) of what is read from an archive's bytes."""
    members, out = warc.Members(pa.BufferReader(data)), []
    while members.more():
        out.append(warc.next_record(members, True)[0])
    return out


def test_an_archive_flipped_or_cut_at_every_byte(monkeypatch):
    parts = [warc.record(i, f"http://a/{i}", f"<p>{'page ' * i}{i}</p>".encode(), None if i % 3 else 9) for i in range(1, 5)]
    data = b"".join(parts)
    starts = np.cumsum([0, *map(len, parts)])
    for read_bytes in (64 << 10, 50):
        monkeypatch.setattr(warc, "READ_BYTES", read_bytes)
        whole = read_all(data)
        assert [r[0] for r in whole] == [1, 2, 3, 4] and not any(r[7] for r in whole)
        for at in range(len(data)):
            hit = int(np.searchsorted(starts, at, "right"))
            for bits in (0x01, 0xFF):
                broken = data[:at] + bytes([data[at] ^ bits]) + data[at + 1:]
                good = [r for r in read_all(broken) if not r[7]]
                assert [r for r in whole if r[0] != hit] == [r for r in good if r[0] != hit], (at, bits)
                assert all(r in whole for r in good)
            good = [r for r in read_all(data[:at]) if not r[7]]
            assert good == whole[:hit - 1], at
            # A byte is missing: the member runs into the next one, which is found again.
            good = [r for r in read_all(data[:at] + data[at + 1:]) if not r[7]]
            assert [r for r in whole if r[0] != hit] == [r for r in good if r[0] != hit], at


def test_broken_archives(spark, tmp_path):
    good = [warc.record(i, "u", f"payload {i}".encode() * 50, None) for i in range(4)]
    flipped = zlib.decompress(good[1], 31).replace(b"payload 1", b"pXyload 1", 1)
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(good[0] + pack.compress(flipped) + pack.flush() + good[2] + good[3][:-20])
    rows = warc.read_archives(spark.createDataFrame([(str(path), 4)], "path string, records long"), folder=str(tmp_path)).collect()
    assert [r["page_id"] for r in rows] == [0, 1, 2, None]
    assert [r["problem"] for r in rows][:3] == [None, "block digest differs", None] and "EOFError" in rows[3]["problem"]


# Pages

CASES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
    ("<table><tr><th>name<th>n<tr><td>x<td>100<tr><td colspan=2>all of it</table>", "name | n\nx    | 100\nall of it"),
    ("<div>a</div><div>b</div>text", "a\nb\ntext"),
    ("a<br>b<script>no()</script><style>x{}</style><!-- no -->c", "a\nbc"),
    ("<head><title>T &amp; t</title><body><p hidden>no</p><p style='display : none'>no</p><i style=\"visibility:hidden\">no</i>yes", "yes"),
    ("<pre>  a\n   b</pre>c", "  a\n   b\n\nc"),
    ("<blockquote><p>q<p>r</blockquote>", "> q\n>\n> r"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<b>bold <p>in</b> it</p>after &lt;x&gt; &eacute;", "bold\n\nin it\n\nafter <x> é"),
    ("<table><tr><td>a<p>b<td>c</table>", "a | c\n  |\nb |"),
    ("<meta charset=x><link>seen<textarea>area &amp;</textarea>", "seenarea &"),
    ("a < b and <3 <a href='x>y'>link</a", "a < b and <3 link</a"),
    ("<select><option>one<option>two</select>", "one\ntwo"),
    ("", ""), ("<", "<"), ("<!--", ""), ("<script>never ends", ""),
    ("<p>İ</p><SCRIPT>x</SCRIPT><p>rest</p>", "İ\n\nrest"), ("<script>a</ſcript>b</script>c", "c"),
    ("<script>'</scripty>'</script\n>c", "c"), ("<title>t</TITLE >x", "x"),
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td>D<td>E</table>", "A | B\n  | C\nD | E"),
    ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a | b | c\nd |   | e\nf |   | g"),
    ("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>", "a | b\nc | d"),
    ("<table><tr><td rowspan=2 colspan=2>wide<td>x<tr><td>y<tr><td>1<td>2<td>3</table>", "wide  | x\n      | y\n1 | 2 | 3"),
    ("<table><tr><td colspan=100000>all<tr><td>b<td>c</table>", "all\nb | c"),
    ("<table><tr><td>" + "word " * 20 + "<td>x<tr><td>a<td>b</table>",
     " ".join(["word"] * 12).ljust(59) + " | x\n" + " ".join(["word"] * 8).ljust(59) + " |\n" + "a".ljust(59) + " | b"),
    ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>z", "yes\nz"),
    ("<p style='visibility:hidden'>no<p>yes", "yes"),
    ("<i title=\"" + "x" * 70_000 + "<b>no</b>\">yes</i>", "yes"),
    ("<a href='x>y>z", "y>z"), ("<a \">x</a><b title='q>r'>y</b>", "xr'>y"),
    ("<div>" * 300 + "a<div hidden>no<div>no</div>no</div>b" + "</div>" * 300 + "c", "ab\nc"),
    ("<b>" * 5000 + "deep" + "</b>" * 5000, "deep"), ("<![CDATA[a<b>&amp;]]>", "a<b>&amp;"),
]


@pytest.mark.parametrize("page", ["<a '" * 40_000, "<a '" * 40_001 + ">", "<![CDATA[" * 40_000, "<script>" * 40_000, "<!--" * 40_000,
                                  "<b>" * 40_000 + "</i>" * 40_000, "<p><b>" * 40_000, "<i><div>" + "<b>" * 40_000 + "</i>" * 40_000, "<" * 200_000,
                                  "<a x=\"<a '>\" '" * 20_000 + "\"", "<p>" + "<table><b>" * 5_000 + "<p>" * 40_000])
def test_time_is_linear_whatever_the_tags(page):
    start = time.process_time()
    layout.page_text(page)
    assert time.process_time() - start < 4


def grown(draw, words, depth, lit=True, seen=True):
    """A random page part and the words of it that show, in order."""
    kind = draw.choice(["text"] * 4 + ["block", "block", "inline", "hidden", "unlit", "lit", "list", "comment", "script"] if depth else ["text"])
    if kind == "text":
        word = f"w{len(words)}"
        words.append(word if lit and seen else None)
        return f" {word} "
    if kind in ("comment", "script"):
        return draw.choice(["<!-- no <b> -->", "<script>if (a < b) 'no</b>'</script>", "<STYLE>no{}</STYLE >"]) if kind == "script" else "<!-- <p hidden> -->"
    tag = {"block": draw.choice(["div", "section", "blockquote", "article"]), "inline": draw.choice(["b", "i", "span"]), "list": "ul"}.get(kind, draw.choice(["div", "span"]))
    mark = {"hidden": draw.choice([" hidden", " style='DISPLAY :none'"]), "unlit": " style=\"visibility: hidden\"", "lit": " style=visibility:visible"}.get(kind, draw.choice(["", " title='a>b'"]))
    lit, seen = {"unlit": False, "lit": True}.get(kind, lit), seen and kind != "hidden"
    inner = [grown(draw, words, depth - 1, lit, seen) for _ in range(draw.randint(1, 4))]
    body = "".join(f"<li>{x}" for x in inner) if kind == "list" else "".join(inner)
    return f"<{tag}{mark}>{body}</{tag.upper()}>"


@pytest.mark.parametrize("seed", range(40))
def test_random_pages_show_the_words_that_are_not_hidden(seed):
    draw, words = random.Random(seed), []
    page = "".join(grown(draw, words, 6) for _ in range(8))
    shown = [w for w in layout.page_text(page)[1].replace("- ", " ").replace(">", " ").split()]
    assert shown == [w for w in words if w], page


def test_random_tables_keep_their_columns():
    """Cells stand where a grid filled cell by cell puts them."""
    for seed in range(60):
        draw = random.Random(seed)
        grid, rows = {}, []
        n = draw.randint(1, 5)
        for r in range(n):
            cells, c = [], 0
            for _ in range(draw.randint(1, 4)):
                while (r, c) in grid:
                    c += 1
                down, wide = draw.choice([1, 1, 1, 2, 3]), draw.choice([1, 1, 1, 2])
                if any((r, c + k) in grid for k in range(wide)):
                    wide = 1
                for i in range(down):
                    for k in range(wide):
                        grid[r + i, c + k] = f"t{r}x{c}" if i == k == 0 else ""
                cells.append(f"<td rowspan={down} colspan='{wide}'>t{r}x{c}")
                c += wide
            rows.append("<tr>" + "".join(cells))
        for line in layout.page_text("<table>" + "".join(rows) + "</table>")[1].split("\n"):
            for place, word in ((line.index(w), w) for w in line.replace("|", " ").split()):
                row, column = map(int, word[1:].split("x"))
                assert grid[row, column] == word
                before = [w for w in line[:place].replace("|", " ").split()]
                assert before == sorted((g for (i, k), g in grid.items() if i == row and k < column and g), key=lambda g: int(g.split("x")[1]))


@pytest.mark.parametrize("page,text", CASES)
def test_layout(page, text):
    assert layout.page_text(page)[1] == text


def test_all_visible_words_stay(spark, sf):
    import re
    for r in spark.read.parquet(f"{sf}/pages.parquet").limit(40).collect():
        body = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->|<!DOCTYPE[^>]*>", "", r["html"])
        import html as h
        want = h.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        got = [w for w in layout.page_text(r["html"])[1].split() if w != "-"]
        assert got == [w for w in want if w != "-"]


def test_deep_and_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<div>" * 5000 + "deep" + "</div>" * 5000), (None, "x"), (4, "<p>x"), (4, "<p>x"), (5, "<a \"" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("no")).withColumn("title", F.lit(1))
    got = pages.visible_text(df).collect()
    assert len(got) == 7 and [r["text"] for r in got][:5] == ["", "", "deep", "x", "x"]
    assert pages.visible_text(df.limit(0)).count() == 0
