"""Cleaning and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import render as R
from ..functions import text as T
from ..operators.dialogues import dialogues, fragments, history_before, part_lines
from .dialect import clean_utterance_sql, has_sql, injected, injected_sql, lines_sql, squeeze_sql, strip_sql, sub_sql
from .registry import query

# ------------------------------------------------------------------ cleaning
SPOKEN = [("I ’ m fine , thanks !It 's ok ; ", " ‘ yes ’"), ("“ so ” ", " well ?no"),
          ("", "  e.g. 3.5 \n\n end \n")]


@query("clean_utterance", f"""
    SELECT conv_id, turn, {clean_utterance_sql(injected_sql('utt', "conv_id || '-' || turn", 'text', SPOKEN))} AS cleaned
    FROM conversations""")
def _(t):
    key = F.concat_ws("-", "conv_id", "turn")
    raw = injected("utt", key, F.col("text"), SPOKEN)
    return t.conversations.select("conv_id", "turn", T.clean_utterance(raw).alias("cleaned"))


HANDLES = [(" .ACTION waves at 10-19-20sUser{id} ", ""), ("hi 11-08-teensUser7, ", " .ACTION"),
           (".action  ", " bye 1-2-ADULTSuser{id}!")]


@query("clean_chat_post", f"""
    SELECT doc_id, {squeeze_sql(sub_sql(sub_sql(injected_sql('post', 'doc_id', 'text', HANDLES),
        r'(?i)^\s*\.ACTION\s*'), V.HANDLE, 'friend'))} AS cleaned FROM documents""")
def _(t):
    raw = injected("post", F.col("doc_id"), F.col("text"), HANDLES)
    return t.documents.select("doc_id", T.clean_chat_post(raw).alias("cleaned"))


BLANKS = [("  \t ", " \r\n "), ("\n\n", "\f end")]


@query("normalize_ws", f"""
    SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN ''
        ELSE {squeeze_sql(injected_sql('ws', 'doc_id', 'text', BLANKS))} END AS cleaned
    FROM documents""")
def _(t):
    raw = injected("ws", F.col("doc_id"), F.col("text"), BLANKS)
    raw = F.when(F.col("doc_id") % 13 != 0, raw)
    return t.documents.select("doc_id", T.normalize_ws(raw).alias("cleaned"))


SNIPPETS = [("\r\n  def f{id}(x):  \r\n", "   "), ("a\rb \t\n", "\n\n")]


@query("clean_snippet", f"""
    WITH s AS (SELECT doc_id, {sub_sql(injected_sql('snip', 'doc_id', 'text', SNIPPETS), chr(13) + chr(10) + '?', chr(10))} AS x
               FROM documents),
    c AS (SELECT doc_id, {strip_sql(r"array_to_string(list_transform(string_split(x, chr(10)), lambda l: regexp_replace(l, '\s+$', '')), chr(10))")} AS y FROM s)
    SELECT doc_id, CASE WHEN length(y) BETWEEN 16 AND 800 THEN y ELSE '' END AS cleaned FROM c""")
def _(t):
    raw = injected("snip", F.col("doc_id"), F.col("text"), SNIPPETS)
    return t.documents.select("doc_id", T.clean_snippet(raw).alias("cleaned"))


TABBED = [("\tif x:\r\n\ta\tbb\tccc  \n\n\n\n\n\n", "\n\n\n\n"), ("abcd\te\r\r\r", "\t"),
          ("\n\n\n1234567\t8\n\n\n\n", "\n")]


@query("normalize_source", f"""
    WITH s AS (SELECT doc_id, {sub_sql(injected_sql('tabs', 'doc_id', 'text', TABBED), chr(13) + chr(10) + '?', chr(10))} AS x
               FROM documents),
    l AS (SELECT doc_id, array_to_string(list_transform(string_split(x, chr(10)), lambda l:
              regexp_replace(list_reduce(string_split(l, chr(9)),
                  lambda a, b: a || repeat(' ', (4 - length(a) % 4)::BIGINT) || b), '\\s+$', '')), chr(10)) AS y FROM s)
    SELECT doc_id, {sub_sql(sub_sql('y', chr(10) + '{4,}', chr(10) * 3), '^' + chr(10) + '+|' + chr(10) + '+$')} || chr(10) AS cleaned
    FROM l""")
def _(t):
    raw = injected("tabs", F.col("doc_id"), F.col("text"), TABBED)
    return t.documents.select("doc_id", T.normalize_source(raw).alias("cleaned"))


MENTIONS = [("<@4711> ", ""), ("hey <@!4711>, ", " <@99>"), ("", " <@!4711>")]


@query("strip_mentions", f"""
    SELECT conv_id, turn, {strip_sql(sub_sql(injected_sql('at', "conv_id || '-' || turn", 'text', MENTIONS), '<@!?4711>'))} AS cleaned
    FROM conversations""")
def _(t):
    raw = injected("at", F.concat_ws("-", "conv_id", "turn"), F.col("text"), MENTIONS)
    return t.conversations.select("conv_id", "turn", T.strip_mentions(raw, "4711").alias("cleaned"))


TASKS = [("Write a python function to find the item {id}. ", ""),
         ("Returns the sum of `x`. ", ""), ("Compute the total of row {id}... ", ""),
         ("write a script that sorts every record by key {id}! ", "")]
_LEAD = sub_sql(injected_sql('task', 'doc_id', 'text', TASKS), V.TASK_LEAD)


@query("clean_task_description", rf"""
    WITH s AS (SELECT doc_id, {squeeze_sql(_LEAD)} AS x FROM documents),
    f AS (SELECT doc_id, CASE WHEN regexp_matches(x, '[.!?]\s') THEN regexp_extract(x, '(?s)^(.*?[.!?])\s', 1) ELSE x END AS y FROM s),
    d AS (SELECT doc_id, regexp_replace({strip_sql('y')}, '\.+$', '') AS z FROM f)
    SELECT doc_id, CASE WHEN length(z) BETWEEN 20 AND 120 AND z LIKE '% %'
        AND NOT {has_sql('z', V.DOC_NOISE)} AND regexp_matches(z, '^[\x00-\x7F]*$')
        THEN lower(substr(z, 1, 1)) || substr(z, 2) END AS description FROM d""")
def _(t):
    raw = injected("task", F.col("doc_id"), F.col("text"), TASKS)
    return t.documents.select(
        "doc_id", T.clean_task_description(T.drop_task_lead(raw)).alias("description"))


def recut(docs):
    """Documents of three or more lines as question, steps and answer."""
    q = F.substring_index("text", "\n", 1)
    a = F.substring_index("text", "\n", -1)
    return (docs.where(F.regexp_count("text", F.lit("\n")) >= 2)
            .select("doc_id", "source", q.alias("question"),
                    F.substring(F.col("text"), F.length(q) + 2,
                                F.length("text") - F.length(q) - F.length(a) - 2).alias("steps"),
                    a.alias("answer")))


RECUT_SQL = """
    SELECT doc_id, source, string_split(text, chr(10))[1] AS question,
        array_to_string(string_split(text, chr(10))[2:-2], chr(10)) AS steps,
        string_split(text, chr(10))[-1] AS answer
    FROM documents WHERE length(text) - length(replace(text, chr(10), '')) >= 2"""


@query("clean_trace", f"""
    WITH r AS ({RECUT_SQL}),
    w AS (SELECT doc_id, question || '  ' || question AS q,
              replace(steps, '. ', '.  ' || chr(10) || chr(10) || ' ' || chr(10) || chr(10)) || ' ' || chr(10) AS s,
              ' ' || answer || chr(10) AS a FROM r)
    SELECT doc_id, {squeeze_sql('q')} AS question,
        {sub_sql(strip_sql(r"array_to_string(list_transform(string_split(" + strip_sql('s') + r", chr(10)), lambda l: regexp_replace(l, '\s+$', '')), chr(10))"), chr(10) + '{3,}', chr(10) * 2)} AS think,
        {squeeze_sql('a')} AS answer FROM w""")
def _(t):
    rows = recut(t.documents)
    return rows.select(
        "doc_id",
        T.squeeze(F.concat_ws("  ", "question", "question")).alias("question"),
        T.squeeze_blank_lines(T.clean_steps(F.concat(
            F.replace(F.col("steps"), F.lit(". "), F.lit(".  \n\n \n\n")), F.lit(" \n"))))
        .alias("think"),
        T.squeeze(F.concat(F.lit(" "), "answer", F.lit("\n"))).alias("answer"))


NOTES = [("He has 3*{id}=<<3*{id}=7>>7. ", "<<1+1=2>>"), ("", " <<open")]


@query("strip_calc_notes", f"""
    SELECT doc_id, {sub_sql(injected_sql('calc', 'doc_id', 'text', NOTES), V.CALC_NOTE)} AS cleaned
    FROM documents""")
def _(t):
    raw = injected("calc", F.col("doc_id"), F.col("text"), NOTES)
    return t.documents.select("doc_id", T.strip_calc_notes(raw).alias("cleaned"))


CONTROLS = [("\x1a\x07 ", "\x7f"), ("\t\r\n", "\x01\x02\x1f")]


@query("strip_control_chars", f"""
    SELECT doc_id, {sub_sql(injected_sql('ctrl', 'doc_id', 'text', CONTROLS), V.CONTROL)} AS cleaned
    FROM documents""")
def _(t):
    raw = injected("ctrl", F.col("doc_id"), F.col("text"), CONTROLS)
    return t.documents.select("doc_id", T.strip_control_chars(raw).alias("cleaned"))


OPTIONS = [("", " Options: A){id} B)2"), ("", " Answer Choices: (A) {id} (B) 2"), ("Q-{id}: ", " optional")]


@query("identity_key", f"""
    WITH s AS (SELECT doc_id, {injected_sql('opt', 'doc_id', 'text', OPTIONS)} AS x FROM documents)
    SELECT doc_id, {sub_sql("lower(split_part(" + sub_sql('x', r'(?i)\b(?:answer\s+choices|options)\b\s*:?', chr(1)) + ", chr(1), 1))", '[^a-z0-9]+')} AS identity
    FROM s""")
def _(t):
    raw = injected("opt", F.col("doc_id"), F.col("text"), OPTIONS)
    return t.documents.select("doc_id", T.identity_key(raw).alias("identity"))


@query("truncate_message", f"""
    SELECT conv_id, turn, substr({squeeze_sql('text')}, 1, 400) AS message FROM conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", T.truncate_message(F.col("text")).alias("message"))


# ----------------------------------------------------------------- rendering
SPOKEN_SQL = "SELECT * FROM conversations WHERE role <> 'system'"
CHAT_SQL = lines_sql(SPOKEN_SQL, f"'{V.CHAT}' || chr(10)", f"'{V.END}' || chr(10)")


def spoken(t):
    """Dialogues as parts of bounded size."""
    return fragments(t.conversations.where("role <> 'system'"))


def tagged_chat(t):
    return spoken(t).select("conv_id", "part", part_lines(f"{V.CHAT}\n", f"{V.END}\n").alias("doc"))


@query("render_dialogue", f"""
    SELECT conv_id, array_to_string(list_transform(turns, lambda u, i:
        (CASE WHEN i % 2 = 1 THEN 'A' ELSE 'B' END) || ': ' || u), chr(10)) || chr(10) || '{V.DIALOG_SEP}' || chr(10) AS doc
    FROM (SELECT conv_id, list(text ORDER BY turn NULLS FIRST, role, text NULLS FIRST) AS turns FROM ({SPOKEN_SQL}) GROUP BY conv_id)""")
def _(t):
    # One document per dialogue; `fragments` and `part_lines` give it in parts of bounded size.
    whole = dialogues(t.conversations.where("role <> 'system'"))
    return whole.select("conv_id", R.render_dialogue(F.col("turns.text")).alias("doc"))


@query("render_tagged_chat", CHAT_SQL)
def _(t):
    return tagged_chat(t)


def event_fields(events):
    """State facts of an event: score always, the others on some rows."""
    return events.select(
        "event_id", "user_id", "ts",
        F.map_filter(F.create_map(
            F.lit("score"), F.get_json_object("props", "$.k"),
            F.lit("over"), F.when(F.col("event_type") == "purchase", "yes").otherwise("no"),
            F.lit("length"), F.when(F.col("event_id") % 3 != 0,
                                    F.floor("value").cast("string")),
            F.lit("food"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")),
            F.lit("turn"), F.when(F.col("event_id") % 5 < 2, F.lit("x"))),
            lambda k, v: v.isNotNull()).alias("fields"))


FIELDS_SQL = """
    SELECT event_id, user_id, 'score' AS k, json_extract_string(props, '$.k') AS v FROM events
    UNION ALL SELECT event_id, user_id, 'over', CASE WHEN event_type = 'purchase' THEN 'yes' ELSE 'no' END FROM events
    UNION ALL SELECT event_id, user_id, 'length', floor(value)::BIGINT::VARCHAR FROM events WHERE event_id % 3 <> 0
    UNION ALL SELECT event_id, user_id, 'food', event_type FROM events WHERE event_id % 4 <> 0
    UNION ALL SELECT event_id, user_id, 'turn', 'x' FROM events WHERE event_id % 5 < 2"""
STATE_SQL = f"""
    SELECT event_id, 's: ' || string_agg(k || ' ' || v, ' ' ORDER BY md5('state:' || event_id || ':' || k)) AS state
    FROM ({FIELDS_SQL}) GROUP BY event_id"""


@query("render_state_block", STATE_SQL)
def _(t):
    rows = event_fields(t.events)
    return rows.select("event_id", R.render_state_block(F.col("fields"), F.col("event_id")).alias("state"))


@query("render_reader_doc", f"""
    WITH s AS ({STATE_SQL}),
    x AS (SELECT s.event_id, state || ' | q: whats the score | a: the score is ' || f.v AS body
          FROM s JOIN ({FIELDS_SQL}) f ON f.event_id = s.event_id AND f.k = 'score')
    SELECT event_id, '{V.READ} ' || body || ' {V.END}' || chr(10) AS doc,
        (instr(body, '| a: ') + 4)::BIGINT AS answer_start FROM x""")
def _(t):
    text = R.reader_text(R.render_state_block(F.col("fields"), F.col("event_id")),
                         F.lit("whats the score"),
                         F.concat(F.lit("the score is "), F.col("fields")["score"]))
    rows = event_fields(t.events).select("event_id", text.alias("text"))
    return rows.select("event_id", R.render_reader_doc(F.col("text")).alias("doc"),
                       R.answer_start(F.col("text")).cast("bigint").alias("answer_start"))


@query("render_prompt", f"""
    WITH h AS (SELECT conv_id, turn, list(text) OVER (PARTITION BY conv_id ORDER BY turn
                   ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS lines, role FROM conversations)
    SELECT conv_id, turn, array_to_string(list_transform(lines, lambda u, i:
        (CASE WHEN (len(lines) - i) % 2 = 0 THEN 'A' ELSE 'B' END) || ': ' || u), chr(10))
        || chr(10) || 'B:' AS prompt, 'B:' AS null_prompt
    FROM h WHERE role = 'user'""")
def _(t):
    rows = history_before(t.conversations, F.col("text"), 8)
    return rows.where("role = 'user'").select(
        "conv_id", "turn",
        R.render_prompt(F.concat("history", F.array("text"))).alias("prompt"),
        R.null_prompt().alias("null_prompt"))


_LANG_SQL = "CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'go' WHEN 'de' THEN 'ruby' ELSE '' END"


@query("render_lang_header", f"""
    SELECT doc_id, CASE {_LANG_SQL} WHEN 'python' THEN '# python' || chr(10)
        WHEN 'ruby' THEN '# ruby' || chr(10) WHEN 'go' THEN '// go' || chr(10) ELSE '' END || {strip_sql('text')} AS doc
    FROM documents""")
def _(t):
    lang = (F.when(F.col("lang") == "en", "python").when(F.col("lang") == "fr", "go")
            .when(F.col("lang") == "de", "ruby").otherwise(""))
    return t.documents.select("doc_id", R.render_code(lang, F.col("text")).alias("doc"))


@query("render_class_doc", f"""
    SELECT doc_id, '{V.CODE}' || chr(10) || {strip_sql('text')} || chr(10) || '{V.CLS}' AS code_doc,
        '{V.ROUTE}' || chr(10) || substr({squeeze_sql('text')}, 1, 400) || chr(10) || '{V.DEST}' AS route_doc,
        '{V.IMG}' || chr(10) || text || chr(10) || '{V.CLS}' AS image_doc FROM documents""")
def _(t):
    x = F.col("text")
    return t.documents.select(
        "doc_id", R.render_class_doc(T.strip(x), V.CODE, V.CLS).alias("code_doc"),
        R.route_doc(x).alias("route_doc"), R.render_class_doc(x, V.IMG, V.CLS).alias("image_doc"))


@query("render_trace_doc", f"""
    SELECT doc_id, '{V.REASON} ' || {strip_sql('question')} || chr(10) || '{V.THINK}' AS prompt,
        ' ' || {strip_sql('steps')} || chr(10) || '{V.ANSWER} ' || {strip_sql('answer')} AS target
    FROM ({RECUT_SQL})""")
def _(t):
    return recut(t.documents).select(
        "doc_id", R.trace_prompt(F.col("question")).alias("prompt"),
        R.trace_target(F.col("steps"), F.col("answer")).alias("target"))


_FENCED_SQL = "CASE WHEN doc_id % 5 = 0 THEN '```' || chr(10) || text || chr(10) || '```' || chr(10) || text WHEN doc_id % 5 = 1 THEN '1 2 3' || chr(10) || '4 5 6' || chr(10) || chr(10) || text ELSE text END"


def _pieces_sql(limit: int) -> str:
    """The fold over parts with states as list elements."""
    room = max(limit - V.MESSAGE_MARGIN, V.LEAST_MESSAGE)
    shut = "CASE WHEN {s}.open THEN {s}.piece || chr(10) || '```' ELSE {s}.piece END"
    return f"""SELECT doc_id, {limit} AS limit_chars, list_append(r.done, {shut.format(s='r')}) AS pieces FROM (
        SELECT doc_id, list_reduce(list_transform(flatten(list_transform(string_split(x, chr(10)), lambda l: list_transform(
            range(1, greatest(length(l), 1) + 1, {room}), lambda a: substr(l, a, {room})))),
            lambda q: {{'done': []::VARCHAR[], 'piece': q, 'open': starts_with(q, '```')}}),
          lambda s, q: CASE WHEN length(s.piece) + 1 + length(q.piece) > {room}
            THEN {{'done': list_append(s.done, {shut.format(s='s')}),
                   'piece': CASE WHEN s.open THEN '```' || chr(10) || q.piece ELSE q.piece END, 'open': s.open <> q.open}}
            ELSE {{'done': s.done, 'piece': s.piece || chr(10) || q.piece, 'open': s.open <> q.open}} END) AS r
        FROM (SELECT doc_id, {_FENCED_SQL} AS x FROM documents))"""


@query("split_message", f"""
    WITH p AS ({_pieces_sql(V.DISCORD_LIMIT)} UNION ALL {_pieces_sql(V.GOOGLE_CHAT_LIMIT)}),
    k AS (SELECT doc_id, limit_chars, list_filter(pieces, lambda x: regexp_matches(x, '[^ \\t\\n\\r]')) AS pieces FROM p),
    f AS (SELECT doc_id, limit_chars, CASE WHEN len(pieces) = 0 THEN [''] ELSE pieces END AS pieces FROM k)
    SELECT doc_id, limit_chars, (generate_subscripts(pieces, 1) - 1)::INTEGER AS piece_no, unnest(pieces) AS piece FROM f""")
def _(t):
    from ..operators.chunking import split_messages
    fenced = (F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("```\n"), "text", F.lit("\n```\n"), "text"))
              .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("1 2 3\n4 5 6\n\n"), "text")).otherwise(F.col("text")))
    docs = t.documents.select("doc_id", fenced.alias("text"))
    return split_messages(docs, "doc_id", F.col("text"), V.DISCORD_LIMIT).unionByName(
        split_messages(docs, "doc_id", F.col("text"), V.GOOGLE_CHAT_LIMIT))


@query("fence_blocks", f"""
    WITH d AS (SELECT doc_id, string_split_regex({_FENCED_SQL}, '\\n[ \\t]*\\n') AS bs FROM documents),
    b AS (SELECT doc_id, generate_subscripts(bs, 1) AS i, unnest(bs) AS b FROM d),
    l AS (SELECT *, list_filter(string_split(b, chr(10)), lambda x: trim(x) <> '') AS ls FROM b),
    m AS (SELECT *, contains(regexp_replace(b, '^\\s+|\\s+$', '', 'g'), chr(10)) AND (
            regexp_matches(b, '{V.MONOSPACE}') OR (len(ls) >= 2
            AND list_min(list_transform(ls, lambda x: length(x))) = list_max(list_transform(ls, lambda x: length(x)))
            AND list_min(list_transform(ls, lambda x: length(x))) BETWEEN {V.GRID_WIDTH[0]} AND {V.GRID_WIDTH[1]}
            AND len(list_distinct(string_split(replace(b, chr(10), ''), ''))) <= {V.GRID_ALPHABET})) AS mono FROM l)
    SELECT doc_id, string_agg(CASE WHEN mono THEN '```' || chr(10) || trim(b, chr(10)) || chr(10) || '```' ELSE b END, chr(10) || chr(10) ORDER BY i) AS text,
        count_if(mono)::BIGINT AS fenced FROM m GROUP BY doc_id""")
def _(t):
    from ..operators.chunking import fence_blocks
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("```\n"), "text", F.lit("\n```\n"), "text")).when(
        F.col("doc_id") % 5 == 1, F.concat(F.lit("1 2 3\n4 5 6\n\n"), "text")).otherwise(F.col("text"))
    rows = t.documents.select("doc_id", text.alias("raw"))
    rows = rows.select("doc_id", "raw", fence_blocks(F.col("raw")).alias("text"))
    marks = (F.length("text") - F.length(F.replace("text", F.lit("```"), F.lit(""))) - F.length("raw")
             + F.length(F.replace("raw", F.lit("```"), F.lit("")))) / 6
    return rows.select("doc_id", "text", marks.cast("bigint").alias("fenced"))
