"""Extraction and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import fixed_values as V
from ..functions import grids as G
from ..functions import text as T
from ..functions.hashing import pick
from ..operators import traces
from ..operators.joins import fixed_table
from .dialect import (S, has_sql, injected, injected_sql, quote, squeeze_sql, strip_sql, sub_sql,
                      u32_sql)
from .on_text import RECUT_SQL, recut, event_fields, FIELDS_SQL
from .registry import query

BOXES = [("", " so \\boxed{{id}}"), ("", " \\boxed{\\frac{{id}}{2}} done\n"),
         ("\\boxed{1} and ", " \\boxed{2 {open"), ("\\boxed{a{b}} ", " }}")]


# The box is found by depth: with at most one nested level in the texts, a pattern tells it.
@query("last_boxed", rf"""
    WITH s AS (SELECT doc_id, {injected_sql('box', 'doc_id', 'text', BOXES)} AS x FROM documents),
    r AS (SELECT doc_id, x, CASE WHEN contains(x, '\boxed{{') THEN
              list_extract(string_split(x, '\boxed{{'), -1) END AS rest FROM s)
    SELECT doc_id, (CASE WHEN rest IS NOT NULL THEN length(x) - length(rest) - 6 ELSE 0 END)::INTEGER AS box_start,
        CASE WHEN regexp_matches(rest, '^(?:[^{{}}]|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*\}}')
            THEN regexp_extract(rest, '^((?:[^{{}}]|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*)\}}', 1) END AS boxed FROM r""")
def _(t):
    x = injected("box", F.col("doc_id"), F.col("text"), BOXES)
    rows = t.documents.select("doc_id", x.alias("x"))
    return rows.select("doc_id", X.last_boxed_start(F.col("x")).alias("box_start"),
                       X.last_boxed(F.col("x")).alias("boxed"))


ENDS = [("", "\nThe answer is: {id}"), ("", " so #### {id}\nThe final answer is {id}."),
        ("Answer: 9\nNow verify. ", "\nThat is all\n{id}"), ("", "\nanswer is \\boxed{{id}}"),
        ("", "\nHence x.\n\\boxed{7}")]
MARK = V.ANSWER_MARK
_M = "(?i)" + MARK


def trailing_sql(x: str) -> str:
    """Text up to the last segment that is no closing clause, stripped."""
    segs = f"string_split_regex({x}, {S(_M)})"
    marks = f"regexp_extract_all({x}, {S(_M)})"
    tail = r"regexp_replace(s, '^\s+|\s+$', '', 'g')"
    last = (f"list_max(list_transform({segs}, lambda s, i: CASE WHEN i = 1 OR length({tail}) > 120 "
            f"OR contains({tail}, chr(10)) THEN i ELSE 0 END))")
    keep = (f"(list_sum(list_transform({segs}[1:{last}], lambda s: length(s))) + "
            f"coalesce(list_sum(list_transform({marks}[1:{last} - 1], lambda s: length(s))), 0))::BIGINT")
    return strip_sql(f"substr({x}, 1, {keep})")


@query("split_answer", rf"""
    WITH s AS (SELECT doc_id, {strip_sql(injected_sql('ends', 'doc_id', 'text', ENDS))} AS x FROM documents),
    p AS (SELECT doc_id, x, CASE WHEN contains(x, '\boxed{{') THEN list_extract(string_split(x, '\boxed{{'), -1) END AS rest,
              {has_sql('x', _M)} AS marked, string_split_regex(x, {S(_M)}) AS segs,
              regexp_extract_all(x, {S(_M)}) AS marks,
              list_filter(list_transform(string_split(x, chr(10)), lambda l: {strip_sql('l')}), lambda l: l <> '') AS lines FROM s),
    q AS (SELECT *, CASE WHEN regexp_matches(rest, '^[^{{}}]*\}}') THEN regexp_extract(rest, '^([^{{}}]*)\}}', 1) END AS box,
              substr(x, 1, length(x) - length(rest) - 7) AS head,
              {strip_sql('list_extract(segs, -1)')} AS tail FROM p),
    b AS (SELECT *, CASE WHEN box IS NOT NULL AND length(box) <= 120 THEN 1
              WHEN marked AND tail <> '' AND length(tail) <= 120 THEN 2 WHEN marked THEN 3
              WHEN len(lines) >= 2 AND length(lines[-1]) <= 120 THEN 4 ELSE 5 END AS how FROM q),
    c AS (SELECT doc_id, how, CASE how
              WHEN 1 THEN CASE WHEN contains(head, chr(10)) THEN substr(head, 1, length(head) - length(list_extract(string_split(head, chr(10)), -1)) - 1) ELSE head END
              WHEN 2 THEN substr(x, 1, length(x) - length(segs[-1]) - length(marks[-1]))
              WHEN 4 THEN array_to_string(lines[1:-2], chr(10)) ELSE x END AS body,
              CASE how WHEN 1 THEN box WHEN 2 THEN tail WHEN 4 THEN lines[-1] ELSE '' END AS answer FROM b)
    SELECT doc_id, CASE WHEN how IN (1, 2, 4) THEN {trailing_sql('body')} ELSE body END AS steps, answer FROM c""")
def _(t):
    x = injected("ends", F.col("doc_id"), F.col("text"), ENDS)
    rows = t.documents.select("doc_id", X.split_answer(x).alias("p"))
    return rows.select("doc_id", "p.steps", "p.answer")


CLOSERS = [("", "\n#### {id}\nThe answer is: {id}"), ("Answer: 9\nNow verify. ", " answer is 3"),
           ("", "\nfinal answer {id} answer: 4 #### 5 \n"), ("", " ####  \n the answer is\n\n more\nsteps")]


@query("strip_trailing_markers", f"""
    WITH s AS (SELECT doc_id, {injected_sql('close', 'doc_id', 'text', CLOSERS)} AS x FROM documents)
    SELECT doc_id, {trailing_sql('x')} AS steps FROM s""")
def _(t):
    x = injected("close", F.col("doc_id"), F.col("text"), CLOSERS)
    return t.documents.select("doc_id", X.strip_trailing_markers(x).alias("steps"))


ANSWERS = [("", " therefore it makes {id}."), ("", " so the share is -1,2{id}.50 % !"),
           ("", " thus \\boxed{{id}}")]


@query("tighten_answer", rf"""
    WITH s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN doc_id || ' red  apples' ELSE
               {injected_sql('tight', 'doc_id', 'text', ANSWERS)} END AS x FROM documents),
    v AS (SELECT doc_id, x, {strip_sql(f"regexp_extract(x, {S(V.TRAILING_VALUE)}, 1)")} AS y FROM s)
    SELECT doc_id, CASE WHEN len(string_split({squeeze_sql('x')}, ' ')) <= 4 OR y = '' THEN x ELSE y END AS answer FROM v""")
def _(t):
    x = F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(" red  apples"))) \
        .otherwise(injected("tight", F.col("doc_id"), F.col("text"), ANSWERS))
    return t.documents.select("doc_id", X.tighten_answer(x).alias("answer"))


RENDERED_SQL = f"""
    WITH raw AS (SELECT *, {traces.KIND_SQL} AS kind, {strip_sql("steps || chr(10) || answer")} AS whole FROM ({RECUT_SQL})),
    lines AS (SELECT *, list_filter(list_transform(string_split(whole, chr(10)), lambda l: {strip_sql('l')}), lambda l: l <> '') AS ls FROM raw),
    parts AS (SELECT *, len(ls) >= 2 AND length(ls[-1]) <= 120 AS two,
        CASE kind WHEN 'options' THEN {strip_sql('question')} || chr(10) || 'Options: A)' || doc_id || ' B)' || (doc_id + 1)
            ELSE question END AS q FROM lines)
    SELECT doc_id, source, kind, q AS question,
        CASE WHEN kind = 'hash_marks' THEN {sub_sql("steps || ' <<1+1=2>> '", V.CALC_NOTE)}
            WHEN kind = 'options' THEN {strip_sql('steps')} WHEN kind IN ('yes_no', 'expected_answer') THEN steps
            WHEN two THEN {strip_sql("array_to_string(ls[1:-2], chr(10))")} ELSE whole END AS think,
        CASE WHEN kind = 'hash_marks' THEN ' ' || doc_id WHEN kind = 'options' THEN 'B'
            WHEN kind = 'yes_no' THEN CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END
            WHEN kind = 'expected_answer' THEN answer WHEN two THEN ls[-1] ELSE '' END AS answer,
        CASE kind WHEN 'rephrased' THEN 'P' || (doc_id // 3) ELSE q END AS identity
    FROM parts WHERE NOT (kind = 'cot_only' AND doc_id % 2 = 0) AND NOT (kind = 'expected_answer' AND doc_id % 10 = 0)"""


@query("render_by_source", RENDERED_SQL)
def _(t):
    return traces.render_all(traces.raw_sources(recut(t.documents)))


@query("numeric_equal", rf"""
    WITH s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text ELSE 'it is 1,' || (doc_id * 7) || '.50 in all' END AS gold,
                      CASE WHEN doc_id % 3 = 0 THEN '1' || (doc_id * 7) || '.5' WHEN doc_id % 3 = 1 THEN 'none' ELSE doc_id || ' clips' END AS answer
               FROM documents),
    n AS (SELECT doc_id, try_cast(regexp_extract(replace(gold, ',', ''), '-?\d+(?:\.\d+)?') AS DOUBLE) AS g,
                 try_cast(regexp_extract(replace(answer, ',', ''), '-?\d+(?:\.\d+)?') AS DOUBLE) AS a FROM s)
    SELECT doc_id, CASE WHEN g IS NOT NULL THEN coalesce(abs(g - a) < 1e-6, false) END AS equal FROM n""")
def _(t):
    gold, answer = gold_and_answer()
    return t.documents.select("doc_id", X.numeric_equal(gold, answer).alias("equal"))


def gold_and_answer():
    i = F.col("doc_id")
    text = i.cast("string")
    gold = F.when(i % 5 == 0, F.col("text")).otherwise(
        F.concat(F.lit("it is 1,"), (i * 7).cast("string"), F.lit(".50 in all")))
    answer = (F.when(i % 3 == 0, F.concat(F.lit("1"), (i * 7).cast("string"), F.lit(".5")))
              .when(i % 3 == 1, "none").otherwise(F.concat(text, F.lit(" clips"))))
    return gold, answer


REPLIES = [("", " (ok!) unfinished"), ("lol", ""), ("Well... ", " really?!")]
_SENT = S(V.SENTENCE)


@query("trim_reply", f"""
    WITH s AS (SELECT conv_id, turn, CASE WHEN turn = 1 THEN 'why not' ELSE
               {injected_sql('trim', "conv_id || '-' || turn", 'text', REPLIES)} END AS x FROM conversations),
    f AS (SELECT conv_id, turn, x, list_transform(regexp_extract_all(x, {_SENT}), lambda q: {strip_sql('q')}) AS l FROM s)
    SELECT conv_id, turn, CASE WHEN len(l) = 0 THEN x WHEN len(l) > 1 AND length(l[1]) <= 100 THEN l[1] || ' ' || l[2]
        ELSE l[1] END AS reply FROM f""")
def _(t):
    key = F.concat_ws("-", "conv_id", "turn")
    x = F.when(F.col("turn") == 1, "why not").otherwise(injected("trim", key, F.col("text"), REPLIES))
    return t.conversations.select("conv_id", "turn", X.trim_reply(x).alias("reply"))


@query("first_sentence", r"""
    SELECT doc_id, CASE WHEN regexp_matches(text, '[.!?]\s') THEN regexp_extract(text, '(?s)^(.*?[.!?])\s', 1)
        ELSE text END AS sentence FROM documents""")
def _(t):
    return t.documents.select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))


VERBS = [("returns the ", ""), ("process the queue ", ""), ("this is ", ""), ("gas ", "")]
_STOP = ", ".join(quote(w) for w in V.NOT_A_VERB)


@query("third_person", f"""
    WITH s AS (SELECT doc_id, split_part({injected_sql('verb', 'doc_id', 'text', VERBS)}, ' ', 1) AS h FROM documents)
    SELECT doc_id, ends_with(h, 's') AND length(h) > 3 AND h NOT IN ({_STOP}) AS third FROM s""")
def _(t):
    x = injected("verb", F.col("doc_id"), F.col("text"), VERBS)
    return t.documents.select("doc_id", X.third_person(x).alias("third"))


FILES = [("look at 'my pic {id}.PNG' and b.py ", ""), ("", " see \"shot.{id}.jpeg\"?"),
         ("", " run tool{id}.rs!"), ("", " not.a.file.txt 'x.md'")]


def _mention_sql(x: str, exts: list[str]) -> str:
    known = S(r"\.(" + "|".join(exts) + ")$")
    return f"""list_filter(list_concat(
        list_transform(regexp_extract_all({x}, '''[^'']+''|"[^"]+"'), lambda q: substr(q, 2, length(q) - 2)),
        list_transform(string_split({squeeze_sql(x)}, ' '), lambda w: regexp_replace(
            regexp_replace(w, '^[''"]+|[''"]+$', '', 'g'), '[?!.,]+$', ''))),
        lambda c: regexp_matches(lower(c), {known}))[1]"""


@query("file_mentions", f"""
    WITH s AS (SELECT doc_id, {injected_sql('file', 'doc_id', 'text', FILES)} AS x FROM documents),
    m AS (SELECT doc_id, {_mention_sql('x', V.IMAGE_EXTS)} AS image, {_mention_sql('x', V.CODE_EXTS)} AS code FROM s)
    SELECT doc_id, image, code, coalesce(image, code) IN (
        SELECT 'tool' || doc_id || '.rs' FROM documents WHERE doc_id % 2 = 0) AS exists_in_table
    FROM m WHERE coalesce(image, code) IS NOT NULL""")
def _(t):
    x = injected("file", F.col("doc_id"), F.col("text"), FILES)
    found = (t.documents.select("doc_id", x.alias("x"))
             .select("doc_id", X.file_mention(F.col("x"), V.IMAGE_EXTS).alias("image"),
                     X.file_mention(F.col("x"), V.CODE_EXTS).alias("code"))
             .withColumn("path", F.coalesce("image", "code")).where("path IS NOT NULL"))
    # The file table names each path once, so the join adds no rows.
    files = (t.documents.where("doc_id % 2 = 0")
             .select(F.concat(F.lit("tool"), F.col("doc_id").cast("string"), F.lit(".rs")).alias("path"),
                     F.lit(True).alias("there")))
    return found.join(files, "path", "left").select(
        "doc_id", "image", "code", F.coalesce("there", F.lit(False)).alias("exists_in_table"))


LANGS = [("write it in JavaScript ", ""), ("use C++ ", " java"), ("go ", ""), ("in py please ", ""),
         ("", " c"), ("node ", "")]


@query("request_language", f"""
    WITH s AS (SELECT doc_id, ' ' || lower({injected_sql('lang', 'doc_id', 'text', LANGS)}) || ' ' AS x FROM documents)
    SELECT doc_id, CASE {' '.join(f"WHEN contains(x, {quote(k)}) THEN {quote(v)}" for k, v in V.LANGUAGE_KEYWORDS)}
        ELSE 'python' END AS language FROM s""")
def _(t):
    x = injected("lang", F.col("doc_id"), F.col("text"), LANGS)
    return t.documents.select("doc_id", X.request_language(x).alias("language"))


CALLS = [("/see pic{id}.png ", ""), ("/Solve  ", ""), ("  /nope ", ""), ("/", "")]
_COMMAND_VALUES = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in V.COMMANDS.items())


@query("parse_command", f"""
    WITH s AS (SELECT conv_id, turn, {strip_sql(injected_sql('cmd', "conv_id || '-' || turn", 'text', CALLS))} AS x FROM conversations),
    p AS (SELECT conv_id, turn, lower(split_part(substr(x, 2), ' ', 1)) AS name,
              {strip_sql("regexp_extract(x, '(?s)^/[^ ]* (.*)$', 1)")} AS arg FROM s WHERE starts_with(x, '/'))
    SELECT conv_id, turn, p.name, arg, command, command IS NULL AS unknown
    FROM p LEFT JOIN (VALUES {_COMMAND_VALUES}) c(name, command) ON p.name = c.name""")
def _(t):
    x = injected("cmd", F.concat_ws("-", "conv_id", "turn"), F.col("text"), CALLS)
    rows = (t.conversations.select("conv_id", "turn", X.command_name(x).alias("name"),
                                   X.command_arg(x).alias("arg")).where("name IS NOT NULL"))
    known = fixed_table(t.spark, list(V.COMMANDS.items()), "name string, command string")
    return rows.join(known, "name", "left").select(
        "conv_id", "turn", "name", "arg", "command", F.col("command").isNull().alias("unknown"))


ASKS = [(q, f) for f, qs in V.QUESTIONS.items() for q in qs] + [(q, None) for q in V.SMALL_TALK]
_ASK_VALUES = ", ".join(f"({i}, {quote(q)}, {quote(f) if f else 'NULL'})" for i, (q, f) in enumerate(ASKS))


@query("read_field", f"""
    WITH a(i, question, field) AS (VALUES {_ASK_VALUES})
    SELECT e.event_id, a.question, coalesce(f.v, '') AS answer
    FROM events e JOIN a ON a.i = {u32_sql('ask', 'e.event_id')} % {len(ASKS)}
    LEFT JOIN ({FIELDS_SQL}) f ON f.event_id = e.event_id AND f.k = a.field""")
def _(t):
    asks = fixed_table(t.spark, [(i, q, f) for i, (q, f) in enumerate(ASKS)],
                       "i bigint, question string, field string")
    rows = event_fields(t.events).withColumn("i", pick("ask", F.col("event_id"), len(ASKS)))
    return rows.join(asks, "i").select(
        "event_id", "question",
        X.read_answer(F.try_element_at("fields", F.col("field")), F.col("field").isNull()).alias("answer"))


@query("cut_first_block", """
    SELECT doc_id, split_part(replace(text, '. ', chr(10) || chr(10)), chr(10) || chr(10), 1) AS block FROM documents""")
def _(t):
    return t.documents.select("doc_id", X.cut_first_block(
        F.replace(F.col("text"), F.lit(". "), F.lit("\n\n"))).alias("block"))


_CS = S(V.READER_CHARS)


def _ids_sql(x: str, fill: int | None) -> str:
    found = f"list_transform(string_split({x}, ''), lambda c: instr({_CS}, c) - 1)"
    if fill is None:
        return f"list_filter({found}, lambda i: i >= 0)"
    return f"list_transform({found}, lambda i: CASE WHEN i < 0 THEN {fill} ELSE i END)"


@query("char_encode", f"""
    SELECT doc_id, array_to_string({_ids_sql('text', None)}, ' ') AS dropped,
        array_to_string({_ids_sql('text', V.READER_CHARS.index(' '))}, ' ') AS spaced,
        array_to_string({_ids_sql('text', len(V.READER_CHARS))}, ' ') AS padded FROM documents""")
def _(t):
    x = F.col("text")
    return t.documents.select("doc_id", *[
        F.array_join(X.char_ids(x, V.READER_CHARS, how), " ").alias(name)
        for how, name in (("drop", "dropped"), ("space", "spaced"), ("pad", "padded"))])


@query("pretokenize", "SELECT doc_id, text AS joined, true AS lossless FROM documents")
def _(t):
    rows = t.documents.select("doc_id", "text", X.pre_tokens(F.col("text")).alias("pieces"))
    joined = F.array_join("pieces", "")
    return rows.select("doc_id", joined.alias("joined"), (joined == F.col("text")).alias("lossless"))


def conversation_ids(t, how: str = "space"):
    return t.conversations.select("conv_id", "turn", X.char_ids(F.col("text"), V.READER_CHARS, how).alias("ids"))


_CONV_IDS = f"SELECT conv_id, turn, {_ids_sql('text', V.READER_CHARS.index(' '))} AS ids FROM conversations"


@query("pad_truncate", f"""
    SELECT conv_id, turn, array_to_string(list_resize(ids, {V.READER_LEN}, {len(V.READER_CHARS)}), ' ') AS ids,
        {V.READER_LEN} AS n FROM ({_CONV_IDS})""")
def _(t):
    padded = X.pad_to(F.col("ids"), V.READER_LEN, len(V.READER_CHARS))
    return conversation_ids(t).select("conv_id", "turn", F.array_join(padded, " ").alias("ids"),
                                      F.size(padded).alias("n"))


_DOT, _NL = V.READER_CHARS.index("."), V.READER_CHARS.index("\n")


@query("split_on_marker", f"""
    WITH i AS ({_CONV_IDS}),
    b AS (SELECT conv_id, turn, CASE WHEN list_contains(ids, {_NL}) THEN ids[1:list_position(ids, {_NL}) - 1] ELSE ids END AS ids FROM i)
    SELECT conv_id, turn,
        array_to_string(CASE WHEN list_contains(ids, {_DOT}) THEN ids[1:list_position(ids, {_DOT}) - 1] ELSE ids END, ' ') AS steps,
        CASE WHEN list_contains(ids, {_DOT}) THEN array_to_string(ids[list_position(ids, {_DOT}) + 1:], ' ') ELSE '' END AS answer
    FROM b""")
def _(t):
    steps, answer = X.split_on(F.col("ids"), _NL, _DOT)
    return conversation_ids(t).select("conv_id", "turn", F.array_join(steps, " ").alias("steps"),
                                      F.array_join(answer, " ").alias("answer"))


@query("keep_last_tokens", f"""
    SELECT conv_id, turn, array_to_string(ids[-32:], ' ') AS tail,
        array_to_string(ids[-(64 - len(ids[1:24])):], ' ') AS context FROM ({_CONV_IDS})""")
def _(t):
    ids = F.col("ids")
    return conversation_ids(t).select(
        "conv_id", "turn", F.array_join(X.keep_last(ids, 32), " ").alias("tail"),
        F.array_join(X.fit_context(ids, F.slice(ids, 1, 24), 64), " ").alias("context"))


@query("confidence_bucket", f"""
    SELECT CASE WHEN c >= 0.75 THEN 'sure' WHEN c >= 0.4 THEN 'likely' ELSE 'unsure' END AS band, quality, count(*) AS n
    FROM (SELECT quality, {u32_sql('conf', 'doc_id')} / 4294967296.0 AS c FROM labels) GROUP BY ALL""")
def _(t):
    from ..functions.hashing import frac
    return (t.labels.withColumn("band", X.confidence_band(frac("conf", F.col("doc_id"))))
            .groupBy("band", "quality").agg(F.count(F.lit(1)).alias("n")))


_CELL = "list_transform(embedding, lambda v: floor(abs(v::DOUBLE) * 10)::INTEGER % 4)"


@query("grid_encode", f"""
    WITH g AS (SELECT vec_id, label, {_CELL} AS c FROM embeddings)
    SELECT vec_id, array_to_string(list_concat(flatten(list_transform(range(8), lambda r: list_append(c[r * 8 + 1:r * 8 + 8], 4))),
        [6 + label, 5]), ' ') AS ids FROM g""")
def _(t):
    cells = F.transform("embedding", lambda v: (F.floor(F.abs(v.cast("double")) * 10) % 4).cast("int"))
    ids = G.encode_grid(G.as_rows(cells, 8), [F.col("label")], n_cells=4, aux_dims=[10])
    return t.embeddings.select("vec_id", F.array_join(ids, " ").alias("ids"))


def _pool_sql(x: str) -> str:
    return f"""list_transform(range(16), lambda k: ({' + '.join(
        f'{x}[(k // 4) * 16 + {a} * 8 + (k % 4) * 2 + {b} + 1]' for a in (0, 1) for b in (0, 1))}) / 4.0)"""


@query("mean_pool_grid", f"""
    WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: (v::DOUBLE + 1) * 127.5) AS r FROM embeddings),
    c AS (SELECT vec_id, r, list_transform(range(64), lambda k: r[(k // 8) * 8 + 8 - k % 8]) AS g, list_reverse(r) AS b FROM p),
    q AS (SELECT vec_id, {_pool_sql('r')} AS r, {_pool_sql('g')} AS g, {_pool_sql('b')} AS b FROM c),
    u AS (SELECT vec_id, unnest(range(16)) AS k, unnest(r) AS r, unnest(g) AS g, unnest(b) AS b FROM q),
    w AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS lum, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS d FROM u),
    h AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN mx = r THEN ((g - b) / d) - 6 * floor(((g - b) / d) / 6)
              WHEN mx = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END AS hue FROM w),
    x AS (SELECT vec_id, k, CASE WHEN d >= {V.CHROMA_MIN} THEN
              CASE WHEN lum >= 128 THEN upper(substr('{V.HUES}', (round_even(hue, 0)::BIGINT % 6) + 1, 1))
              ELSE substr('{V.HUES}', (round_even(hue, 0)::BIGINT % 6) + 1, 1) END
              ELSE substr('{V.GLYPHS}', (least(greatest(floor(lum * 4 / 256), 0), 3) + 1)::BIGINT, 1) END AS ch FROM h)
    SELECT vec_id, string_agg(ch || CASE WHEN k % 4 = 3 AND k < 15 THEN chr(10) ELSE '' END, '' ORDER BY k) AS glyphs
    FROM x GROUP BY vec_id""")
def _(t):
    red = F.transform("embedding", lambda v: (v.cast("double") + 1) * 127.5)
    rows = t.embeddings.select("vec_id", G.as_rows(red, 8).alias("r"))
    rows = rows.withColumn("g", G.mirror("r")).withColumn(
        "b", F.reverse(F.transform("r", lambda row: F.reverse(row))))
    pooled = rows.select("vec_id", *[G.mean_pool(F.col(c), 8, 2).alias(c) for c in "rgb"])
    return pooled.select("vec_id", G.glyph_text("r", "g", "b").alias("glyphs"))
