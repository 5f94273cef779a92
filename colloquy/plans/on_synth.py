"""Synthetic labelled data. Rows of the tables are the keys the draws come from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import predicates as P
from ..functions import text as T
from ..functions.hashing import held_out, md5_order
from ..functions.once import keep_computed
from ..operators import synth as Y
from .dialect import byte_sql, clean_utterance_sql, has_sql, injected, injected_sql, md5_sql, quote, squeeze_sql, strip_sql, sub_sql, u32_sql
from .on_filters import plain_chat_sql
from .on_text import TASKS
from .registry import query


def arr(values: list) -> str:
    return "[" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in values) + "]"


def pick_sql(seed: str, key: str, values: list) -> str:
    return f"({arr(values)})[{u32_sql(seed, key)} % {len(values)} + 1]"


def frac_sql(seed: str, key: str) -> str:
    return f"({u32_sql(seed, key)} / 4294967296.0)"


def _state_sql(key: str, allow_held: bool) -> dict[str, str]:
    score = f"{u32_sql('score', key)} % 100" if allow_held else pick_sql("score", key, Y.ALLOWED_SCORES)
    return {"score": f"({score})::VARCHAR", "over": pick_sql("over", key, ["yes", "no"]),
            "length": f"CASE WHEN {frac_sql('has_length', key)} < 0.7 THEN ({u32_sql('length', key)} % 40 + 1)::VARCHAR END",
            "food": f"CASE WHEN {frac_sql('has_food', key)} < 0.7 THEN {pick_sql('food', key, V.DIRECTIONS)} END",
            "turn": f"CASE WHEN {frac_sql('has_turn', key)} < 0.4 THEN {pick_sql('turn', key, ['x', 'o'])} END"}


_STATE = ", ".join(f'{v} AS "{k}"' for k, v in _state_sql("event_id", False).items())


@query("synth_states", f"""
    SELECT event_id, {', '.join(f'{v} AS {k}' for k, v in _state_sql('event_id', False).items() if k not in ('over',))},
        {_state_sql('event_id', False)['over']} AS is_over, {_state_sql('event_id', True)['score']} AS any_score FROM events""")
def _(t):
    key = F.col("event_id")
    rows = t.events.select("event_id", Y.state_fields(key, False).alias("f"), Y.state_fields(key, True).alias("g"))
    return rows.select("event_id", *[F.try_element_at("f", F.lit(k)).alias(k) for k in ("score", "length", "food", "turn")],
                       F.try_element_at("f", F.lit("over")).alias("is_over"),
                       F.try_element_at("g", F.lit("score")).alias("any_score"))


def _map(table: dict[str, list[str]], field: str) -> str:
    return f"CASE {field} {' '.join(f'WHEN {quote(k)} THEN {arr(v)}' for k, v in table.items())} END"


def _choice(options: str, seed: str, key: str) -> str:
    return f"({options})[({u32_sql(seed, key)} % {1 << 20}) % len({options}) + 1]"


_FIELDS = list(V.QUESTIONS)


@query("synth_reader_examples", f"""
    WITH s AS (SELECT event_id, {_STATE} FROM events),
    n AS (SELECT *, [f FOR f IN {arr(_FIELDS)} IF (CASE f {' '.join(f"WHEN '{f}' THEN {chr(34)}{f}{chr(34)}" for f in _FIELDS)} END) IS NOT NULL] AS present,
        [f FOR f IN {arr(_FIELDS)} IF (CASE f {' '.join(f"WHEN '{f}' THEN {chr(34)}{f}{chr(34)}" for f in _FIELDS)} END) IS NULL] AS absent FROM s),
    k AS (SELECT *, CASE WHEN {frac_sql('roll', 'event_id')} < 0.2 THEN 'talk' WHEN {frac_sql('roll', 'event_id')} < 0.3 AND len(absent) > 0 THEN 'absent' ELSE 'present' END AS kind FROM n),
    f AS (SELECT *, CASE WHEN kind = 'absent' THEN {_choice('absent', 'field', 'event_id')} ELSE {_choice('present', 'field', 'event_id')} END AS field FROM k),
    v AS (SELECT *, CASE field {' '.join(f"WHEN '{f}' THEN {chr(34)}{f}{chr(34)}" for f in _FIELDS)} END AS v, {_map(V.QUESTIONS, 'field')} AS qs, {_map(V.ANSWER_FORMS, 'field')} AS forms FROM f)
    SELECT event_id, kind, CASE WHEN kind = 'talk' THEN {pick_sql('talk', 'event_id', V.SMALL_TALK)} ELSE {_choice('qs', 'question', 'event_id')} END AS question,
        CASE WHEN kind <> 'present' THEN '' WHEN field = 'over' THEN CASE v WHEN 'yes' THEN {quote(V.OVER_ANSWERS['yes'])} ELSE {quote(V.OVER_ANSWERS['no'])} END
            ELSE replace({_choice('forms', 'form', 'event_id')}, '{{v}}', v) END AS answer FROM v""")
def _(t):
    rows = t.events.select("event_id", Y.state_fields(F.col("event_id"), False).alias("f"))
    kind, question, answer = Y.reader_example(F.col("f"), F.col("event_id"))
    return rows.select("event_id", kind.alias("kind"), question.alias("question"), answer.alias("answer"))


def perturb_sql(phrase: str, k: str) -> str:
    """A scalar subquery, so that each step names the one before."""
    return f"""(SELECT {squeeze_sql(f"CASE WHEN {frac_sql('case', k)} < 0.40 THEN upper(substr(c, 1, 1)) || substr(c, 2) WHEN {frac_sql('case', k)} < 0.44 THEN upper(c) ELSE c END")}
        FROM (SELECT CASE WHEN regexp_matches(b, '[?!.]$') THEN b ELSE b || {pick_sql('ending', k, V.ENDINGS)} END AS c
        FROM (SELECT CASE WHEN {frac_sql('p_tail', k)} < 0.20 THEN a || {pick_sql('tail', k, V.TAILS)} ELSE a END AS b
        FROM (SELECT CASE WHEN {frac_sql('p_filler', k)} < 0.30 THEN {pick_sql('filler', k, V.FILLERS)} || {phrase} ELSE {phrase} END AS a))))"""


def held_templates_sql(templates: list[str]) -> str:
    values = ", ".join(f"({quote(x)})" for x in sorted(set(templates)))
    return f"""(SELECT template FROM (SELECT template, row_number() OVER (ORDER BY md5(template)) AS rn
        FROM (VALUES {values}) v(template)) WHERE (rn - 1) % 6 = 0)"""


def phrases_sql(rows: str, key: str, pairs: list[tuple[str, str]], seed: str) -> str:
    """SELECT of (key, template, held_out, text) over `rows`(key)."""
    values = ", ".join(f"({i}, {quote(a)}, {quote(b)})" for i, (a, b) in enumerate(pairs))
    return f"""SELECT {key}, template, template IN {held_templates_sql([a for a, _ in pairs])} AS held_out, {perturb_sql('phrase', 'k')} AS text
        FROM (SELECT {key}, '{seed}-' || {key} AS k FROM {rows}) r JOIN (VALUES {values}) v(i, template, phrase) ON i = {u32_sql('pair', 'k')} % {len(pairs)}"""


VISION = Y.template_phrases(V.VISION_TEMPLATES, V.VISION_SLOTS)
CODE = Y.template_phrases(V.CODE_TEMPLATES, V.CODE_SLOTS)
GAME = Y.template_phrases(V.GAME_TEMPLATES, V.GAME_SLOTS) + [(q, q) for qs in V.QUESTIONS.values() for q in qs]


@query("synth_template_messages", phrases_sql("orders", "o_orderkey", VISION, "vision"))
def _(t):
    out = Y.template_messages(t.orders.select("o_orderkey"), "o_orderkey", VISION, "vision")
    return out.select("o_orderkey", "template", "held_out", "text")


def arithmetic_sql(rows: str, key: str) -> str:
    values = ", ".join(f"({i}, {quote(x)})" for i, x in enumerate(V.ARITHMETIC_TEMPLATES))
    filled = "template"
    for n, v in (("a", f"({u32_sql('a', 'k')} % 998 + 2)"), ("b", f"({u32_sql('b', 'k')} % 98 + 2)"),
                 ("c", f"({u32_sql('c', 'k')} % 98 + 2)"), ("p", pick_sql("p", "k", V.PERCENTS))):
        filled = f"replace({filled}, '{{{n}}}', {v}::VARCHAR)"
    return f"""SELECT {key}, template, template IN {held_templates_sql(V.ARITHMETIC_TEMPLATES)} AS held_out, {perturb_sql('filled', 'k')} AS text
        FROM (SELECT {key}, k, template, {filled} AS filled FROM (SELECT {key}, 'sum-' || {key} AS k FROM {rows}) r
            JOIN (VALUES {values}) v(i, template) ON i = {u32_sql('pair', 'k')} % {len(V.ARITHMETIC_TEMPLATES)})"""


@query("synth_arithmetic", arithmetic_sql("orders", "o_orderkey"))
def _(t):
    return Y.arithmetic(t.orders.select("o_orderkey"), "o_orderkey").select("o_orderkey", "template", "held_out", "text")


_LEAD = sub_sql(injected_sql("task", "doc_id", "text", TASKS), V.TASK_LEAD)
DESC_SQL = rf"""
    SELECT doc_id, lower(substr(z, 1, 1)) || substr(z, 2) AS description FROM (
        SELECT doc_id, regexp_replace({strip_sql('y')}, '\.+$', '') AS z FROM (
            SELECT doc_id, CASE WHEN regexp_matches(x, '[.!?]\s') THEN regexp_extract(x, '(?s)^(.*?[.!?])\s', 1) ELSE x END AS y
            FROM (SELECT doc_id, {squeeze_sql(_LEAD)} AS x FROM documents)))
    WHERE length(z) BETWEEN 20 AND 120 AND z LIKE '% %' AND NOT {has_sql('z', V.DOC_NOISE)} AND regexp_matches(z, '^[\x00-\x7F]*$')"""
_STOP = ", ".join(quote(w) for w in V.NOT_A_VERB)
REQUESTS_SQL = f"""
    SELECT doc_id, description, {byte_sql('lower(' + strip_sql('description') + ')')} % 6 = 0 AS held_out, {perturb_sql('filled', 'k')} AS text FROM (
        SELECT doc_id, description, k, replace(replace(ask, '{{lang}}', {pick_sql('lang', 'k', V.REQUEST_LANGS)}), '{{desc}}', description) AS filled FROM (
            SELECT doc_id, description, k, CASE WHEN ends_with(h, 's') AND length(h) > 3 AND h NOT IN ({_STOP})
                THEN {pick_sql('that', 'k', V.ASK_THAT)} ELSE {pick_sql('to', 'k', V.ASK_TO)} END AS ask
            FROM (SELECT doc_id, description, 'ask-' || doc_id AS k, split_part(description, ' ', 1) AS h FROM ({DESC_SQL}))))"""


def request_rows(t) -> DataFrame:
    raw = injected("task", F.col("doc_id"), F.col("text"), TASKS)
    desc = keep_computed(t.documents.select("doc_id", raw.alias("text")), {
        "description": T.clean_task_description(T.drop_task_lead(F.col("text")))},
        lambda r: r["description"].isNotNull())
    return Y.requests(desc.drop("text"), "doc_id", "description")


@query("synth_requests", REQUESTS_SQL)
def _(t):
    return request_rows(t).select("doc_id", "description", "held_out", "text")


CAPS = V.ROUTE_CAPS
LEAST_VAL = 18
_CAP_SQL = "CASE label " + " ".join(
    f"WHEN '{c}' THEN CASE WHEN held_out THEN {max(n // 6, LEAST_VAL)} ELSE {n} END" for c, n in CAPS.items()) + " END"
_TURN = "(conv_id || '-' || turn)"


def _class_sql(label: str, key: str, source: str) -> str:
    return f"SELECT '{label}' AS label, {md5_sql('place-' + label, key)} AS place, held_out, text FROM ({source})"


_CHAT_SQL = (f"SELECT {_TURN} AS id, {byte_sql('lower(' + strip_sql('x') + ')')} % 6 = 0 AS held_out, x AS text FROM "
             f"(SELECT conv_id, turn, {clean_utterance_sql('text')} AS x FROM conversations WHERE role <> 'system') WHERE {plain_chat_sql('x')}")
_QUESTION_SQL = (f"SELECT doc_id, {byte_sql('lower(x)')} % 6 = 0 AS held_out, x AS text FROM "
                 f"(SELECT doc_id, {squeeze_sql('text')} AS x FROM documents) WHERE length(x) BETWEEN 12 AND 400")
CORPUS_SQL = f"""
    WITH m AS ({_class_sql('chat', 'id', _CHAT_SQL)}
        UNION ALL {_class_sql('reason', "('q' || doc_id)", _QUESTION_SQL)}
        UNION ALL {_class_sql('reason', "('a' || o_orderkey)", arithmetic_sql('orders', 'o_orderkey'))}
        UNION ALL {_class_sql('codegen', 'doc_id', REQUESTS_SQL)}
        UNION ALL {_class_sql('code', 'o_orderkey', phrases_sql('orders', 'o_orderkey', CODE, 'code'))}
        UNION ALL {_class_sql('vision', 'o_orderkey', phrases_sql('orders', 'o_orderkey', VISION, 'vision'))}
        UNION ALL {_class_sql('game', 'o_orderkey', phrases_sql('orders', 'o_orderkey', GAME, 'game'))}),
    c AS (SELECT label, place, held_out, substr({squeeze_sql('text')}, 1, 400) AS text FROM m),
    d AS (SELECT *, row_number() OVER (PARTITION BY label, lower(text) ORDER BY place) AS copy FROM c WHERE text <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY label, held_out ORDER BY place) AS rn FROM d WHERE copy = 1)
    SELECT label, held_out, text FROM r WHERE rn <= {_CAP_SQL}"""


def class_messages(t) -> DataFrame:
    """(label, place, held_out, text) of all classes, each from its own source."""
    chat = keep_computed(t.conversations.where("role <> 'system'").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "text"),
        {"text": T.clean_utterance(F.col("text"))}, lambda r: P.plain_chat(r["text"]))
    chat = chat.withColumn("held_out", held_out(F.lower(T.strip(F.col("text"))), V.ROUTE_HOLDOUT))
    asked = keep_computed(t.documents.select(
        F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("id"), "text"),
        {"text": T.normalize_ws(F.col("text"))}, lambda r: P.question_length(r["text"]))
    asked = asked.withColumn("held_out", held_out(F.lower("text"), V.ROUTE_HOLDOUT))
    # Few bytes but much work per key, so every core gets a share of a table in few splits.
    keys = t.orders.select(F.col("o_orderkey").alias("id")).repartition(t.spark.sparkContext.defaultParallelism, "id")
    sums = Y.arithmetic(keys, "id").withColumn("id", F.concat(F.lit("a"), F.col("id").cast("string")))
    sources = [("chat", chat), ("reason", asked), ("reason", sums),
               ("codegen", request_rows(t).withColumnRenamed("doc_id", "id")),
               ("code", Y.template_messages(keys, "id", CODE, "code")),
               ("vision", Y.template_messages(keys, "id", VISION, "vision")),
               ("game", Y.template_messages(keys, "id", GAME, "game"))]
    parts = [rows.select(F.lit(label).alias("label"), md5_order(f"place-{label}", F.col("id")).alias("place"),
                         "held_out", "text") for label, rows in sources]
    return reduce(DataFrame.unionByName, parts)


@query("labelled_corpus", CORPUS_SQL)
def _(t):
    return Y.labelled_corpus(class_messages(t), CAPS, LEAST_VAL).select("label", "held_out", "text")
