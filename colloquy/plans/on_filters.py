"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import predicates as P
from ..functions import text as T
from ..functions.hashing import pick
from ..functions.once import keep_computed
from ..operators import dialogues as D
from ..operators.joins import fixed_table
from ..session import shared_dir
from .dialect import (LEFT, RIGHT, clean_utterance_sql, has_sql, injected, injected_sql, parts_sql, quote, squeeze_sql,
                      u32_sql, word_sql)
from .on_text import RECUT_SQL, recut
from .registry import query

# The tables' turns run long, so the limit is raised for them; it is a parameter.
LONG = 2000


@query("filter_two_speakers", f"""
    WITH c AS (SELECT conv_id, turn, role, {clean_utterance_sql('text')} AS text,
                   lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE role <> 'system')
    SELECT conv_id, count(*) AS n_turns, bool_and(length(text) <= 320) AS short FROM c GROUP BY conv_id
    HAVING count(*) >= 2 AND count(DISTINCT role) = 2 AND bool_and(prev IS NULL OR prev <> role)
        AND min(length(text)) >= 1 AND max(length(text)) <= {LONG}""")
def _(t):
    turns = t.conversations.where("role <> 'system'").withColumn("text", T.clean_utterance(F.col("text")))
    shared_dir(t.spark)
    kept = D.two_speaker_turns(turns.checkpoint(), LONG)
    return kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.bool_and(
        F.length("text") <= V.MAX_UTTERANCE_CHARS).alias("short"))


def _kept_sql(turns: str) -> str:
    return f"""SELECT conv_id, part, string_agg(text, chr(10) ORDER BY pos) AS kept, count(*) AS n_turns
    FROM ({parts_sql(turns)}) WHERE n >= 2 GROUP BY conv_id, part"""


def kept_parts(turns):
    """Dialogues of which two turns are left, as parts of bounded size."""
    return D.fragments(turns).where("n >= 2").select(
        "conv_id", "part", F.array_join("turns.text", "\n").alias("kept"), F.size("turns").cast("bigint").alias("n_turns"))


@query("filter_long_turns", _kept_sql(f"""
    SELECT conv_id, turn, role, text FROM (SELECT conv_id, turn, role, {clean_utterance_sql('text')} AS text FROM conversations WHERE role <> 'system')
    WHERE length(text) BETWEEN 1 AND 320"""))
def _(t):
    # Turns go before they are collected, so only kept text is shuffled.
    turns = keep_computed(t.conversations.where("role <> 'system'"), {
        "text": T.clean_utterance(F.col("text"))},
        lambda r: F.length(r["text"]).between(1, V.MAX_UTTERANCE_CHARS))
    return kept_parts(turns)


@query("filter_system_turns", _kept_sql(f"SELECT * FROM conversations WHERE role <> 'system' AND length(text) BETWEEN 1 AND {LONG}"))
def _(t):
    return kept_parts(t.conversations.where((F.col("role") != "system") & F.length("text").between(1, LONG)))


CRUDE = [("such a Naked truth ", ""), ("", " sexy"), ("cockpit ", ""), ("titan ", " unnude")]
# One pattern on both sides but for the borders; \w is ASCII in RE2.
_BLOCK_SQL = V.BLOCKLIST.replace(r"\b(?:", "(?:").removesuffix(r"\b").replace(r"\w*", r"[\p{L}\p{N}_]*")


@query("blocklist_filter", f"""
    WITH s AS (SELECT doc_id, {injected_sql('crude', 'doc_id', 'text', CRUDE)} AS x FROM documents)
    SELECT doc_id, {word_sql('x', _BLOCK_SQL)} AS blocked FROM s""")
def _(t):
    x = injected("crude", F.col("doc_id"), F.col("text"), CRUDE)
    return t.documents.select("doc_id", P.blocked(x).alias("blocked"))


@query("has_content", """
    WITH s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '!? 12' WHEN doc_id % 5 = 1 THEN '...' ELSE text END AS x FROM documents)
    SELECT doc_id, regexp_matches(x, '[A-Za-z0-9]') AS content, regexp_matches(x, '[A-Za-z]') AS letter FROM s""")
def _(t):
    x = F.when(F.col("doc_id") % 5 == 0, "!? 12").when(F.col("doc_id") % 5 == 1, "...").otherwise(F.col("text"))
    return t.documents.select("doc_id", P.has_content(x).alias("content"), P.has_letter(x).alias("letter"))


@query("acceptable_reply", f"""
    WITH p AS (SELECT conv_id, turn, role, text AS candidate,
                   lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS user_text FROM conversations),
    q AS (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN lower(user_text) ELSE candidate END AS candidate, user_text
          FROM p WHERE role = 'assistant')
    SELECT conv_id, turn, regexp_matches(candidate, '[A-Za-z]') AND length(candidate) <= 200
        AND lower(candidate) <> lower(coalesce(user_text, '')) AND NOT {word_sql('candidate', _BLOCK_SQL)} AS ok FROM q""")
def _(t):
    from ..operators.scan import sliding
    rows = sliding(t.conversations.withColumn("candidate", F.col("text")), ["turn"], ["conv_id"], 1,
                   {"user_text": lambda frame: F.first("text").over(frame(-1, -1))})
    rows = rows.where("role = 'assistant'").withColumn("candidate", F.when(
        F.col("conv_id") % 9 == 0, F.lower("user_text")).otherwise(F.col("candidate")))
    return rows.select("conv_id", "turn", P.acceptable_reply(F.col("candidate"), F.col("user_text")).alias("ok"))


SOURCES = [("var a=1,b=2,c=3;\nfunction f(p,q){return p}\nx=a\ny=b\n", ""),
           ("import x\n\nvalue = compute(first, second)\nprint(value)\n", ""),
           ("const _0x3fa2 = 1;\n\n\n\n", ""), ("a\n\n\nb_classCallCheck _inherits(\n", ""),
           ("x = '\\x41\\x42\\x43'\n\n\n", "\n" + "z" * 30), ("short\n\n\n", "")]
_EXT_SQL = "(['py','js','ts','go'])[doc_id % 4 + 1]"
_SRC_SQL = (f"CASE WHEN {u32_sql('code', 'doc_id')} % 7 = 5 THEN 'tiny' ELSE "
            f"{injected_sql('code', 'doc_id', 'text', SOURCES)} END")
_FINGER_SQL = "(" + " OR ".join(has_sql("x", p) for p in V.MACHINE_FINGERPRINTS) + ")"
_KEYWORDS = "[" + ", ".join(quote(k) for k in V.CODE_KEYWORDS) + "]"
# A name is a whole word, accented letters counted, that is written in ASCII.
_NAMES = (r"list_filter(regexp_extract_all(x, '[\p{L}\p{N}_]+(?:\$+[\p{L}\p{N}_]+)*'), lambda n: "
          f"regexp_matches(n, '^[A-Za-z_][A-Za-z0-9_$]*$') AND NOT list_contains({_KEYWORDS}, n))")
_SHORT_SQL = f"coalesce(len(list_filter({_NAMES}, lambda n: length(n) <= 2)) / nullif(len({_NAMES}), 0), 0)"
CODE_ROWS_SQL = f"SELECT doc_id, {_EXT_SQL} AS ext, {_SRC_SQL} AS x FROM documents"
VERDICT_SQL = f"""
    SELECT doc_id, ext, x, CASE WHEN length(x) < 40 THEN 'too short'
        WHEN len(string_split(x, chr(10))) - 1 < 3 THEN 'few lines'
        WHEN list_max(list_transform(string_split(x, chr(10)), lambda l: length(l))) > 400 THEN 'long line'
        WHEN {_FINGER_SQL} THEN 'machine made'
        WHEN ext IN ('js', 'ts') AND length(x) / len(string_split(x, chr(10))) > 120 THEN 'dense'
        WHEN ext IN ('js', 'ts') AND {_SHORT_SQL} > 0.5 THEN 'short names' END AS reason
    FROM ({CODE_ROWS_SQL})"""


def code_rows(t):
    """Documents dressed as source files of four extensions, with their source."""
    x = injected("code", F.col("doc_id"), F.col("text"), SOURCES)
    x = F.when(pick("code", F.col("doc_id"), 7) == 5, "tiny").otherwise(x)
    ext = F.get(F.array(*[F.lit(e) for e in ("py", "js", "ts", "go")]), (F.col("doc_id") % 4).cast("int"))
    return t.documents.select("doc_id", "source", ext.alias("ext"), x.alias("x"))


@query("keep_source_file", f"SELECT doc_id, ext, reason IS NULL AS keep, reason FROM ({VERDICT_SQL})")
def _(t):
    rows = code_rows(t).withColumn("reason", P.file_verdict(F.col("ext"), F.col("x")))
    return rows.select("doc_id", "ext", F.col("reason").isNull().alias("keep"), "reason")


@query("machine_generated", rf"""
    WITH s AS (SELECT doc_id, x, CASE ext WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' END AS lang
               FROM ({CODE_ROWS_SQL})),
    l AS (SELECT *, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '\S')) AS ls FROM s)
    SELECT doc_id, lang, {_FINGER_SQL} OR len(ls) = 0 OR coalesce(list_max(list_transform(ls, lambda l: length(l))), 0) > 400
        OR ((lang IS NULL OR lang = 'javascript') AND (
            coalesce(list_sum(list_transform(ls, lambda l: length(l))) / nullif(len(ls), 0), 0) > 120 OR {_SHORT_SQL} > 0.5)) AS machine
    FROM l""")
def _(t):
    lang = (F.when(F.col("ext") == "py", "python").when(F.col("ext") == "js", "javascript")
            .when(F.col("ext") == "go", "go"))
    return code_rows(t).withColumn("lang", lang).select(
        "doc_id", "lang", P.machine_generated(F.col("x"), F.col("lang")).alias("machine"))


TALK = [("How much is {id}0? ", ""), ("what language is it ", ""), ("write me a small function ", ""),
        ("how many ", ""), ("whats the score ", ""), ("in the Picture ", "")]


def _conflict_sql(x: str) -> str:
    # Every branch is \b..\b, so the borders can be taken once, outside.
    inner = "|".join(b.removeprefix(r"\b").removesuffix(r"\b") for b in V.CONFLICT.split(r"|\b"))
    return word_sql(x, f"(?:{inner})")


def _quantity_sql(x: str) -> str:
    inner = "|".join(b.removeprefix(r"\b").removesuffix(r"\b") for b in V.QUANTITY.split(r"|\b"))
    return word_sql(x, f"(?:{inner})")


def plain_chat_sql(x: str) -> str:
    return (f"(length({x}) BETWEEN 1 AND 200 AND NOT {_conflict_sql(x)} AND NOT ({_quantity_sql(x)} "
            f"AND len(regexp_extract_all({x}, '\\d')) >= 2))")


@query("plain_chat", f"""
    WITH s AS (SELECT conv_id, turn, {injected_sql('talk', "conv_id || '-' || turn", 'text', TALK)} AS x FROM conversations)
    SELECT conv_id, turn, {plain_chat_sql('x')} AS plain FROM s""")
def _(t):
    x = injected("talk", F.concat_ws("-", "conv_id", "turn"), F.col("text"), TALK)
    return t.conversations.select("conv_id", "turn", P.plain_chat(x).alias("plain"))


@query("question_length", f"""
    SELECT doc_id, {squeeze_sql('text')} AS question FROM documents WHERE length({squeeze_sql('text')}) BETWEEN 12 AND 400""")
def _(t):
    rows = keep_computed(t.documents.select("doc_id", "text"), {
        "question": T.normalize_ws(F.col("text"))}, lambda r: P.question_length(r["question"]))
    return rows.select("doc_id", "question")


@query("trace_filters", f"""
    SELECT doc_id, length(question) AS q, length(steps) AS s, length(answer) AS a FROM ({RECUT_SQL})
    WHERE length(question) BETWEEN 1 AND 600 AND length(steps) >= 40 AND length(answer) BETWEEN 1 AND 120
        AND length(question) + length(steps) + length(answer) <= 1200""")
def _(t):
    rows = recut(t.documents).where(P.trace_ok(F.col("question"), F.col("steps"), F.col("answer")))
    return rows.select("doc_id", F.length("question").alias("q"), F.length("steps").alias("s"),
                       F.length("answer").alias("a"))


WITH_CODE = [("<llm-code> ", ""), ("", "\n```\nx\n```")]


@query("drop_code_solutions", f"""
    WITH s AS (SELECT doc_id, source, {injected_sql('llm', 'doc_id', 'text', WITH_CODE)} AS x,
        CASE WHEN doc_id % 2 = 0 THEN 'data/PoT/' ELSE 'data/CoT/' END || source AS origin FROM documents)
    SELECT doc_id, origin FROM s WHERE contains(origin, '/CoT/') AND NOT contains(x, '<llm-code>') AND NOT contains(x, '```')""")
def _(t):
    x = injected("llm", F.col("doc_id"), F.col("text"), WITH_CODE)
    origin = F.concat(F.when(F.col("doc_id") % 2 == 0, "data/PoT/").otherwise("data/CoT/"), "source")
    # The cheap test first.
    return (t.documents.withColumn("origin", origin).where(F.contains("origin", F.lit("/CoT/")))
            .where(~P.has_code(x)).select("doc_id", "origin"))


_PAGE_NAME = """regexp_extract(url, '[^/]*$') || (['.png', '.PY', '.exe', '.jpeg', ''])[page_id % 5 + 1]"""


@query("attachment_gate", rf"""
    WITH s AS (SELECT page_id, {_PAGE_NAME} AS name, length(html) * (page_id % 3) * 3000 AS n_bytes FROM pages)
    SELECT page_id, name, CASE WHEN NOT regexp_matches(lower(name), '\.({'|'.join(V.IMAGE_EXTS + V.CODE_EXTS)})$') THEN 'unknown type'
        WHEN n_bytes > {V.MAX_ATTACHMENT_BYTES} THEN 'too large' END AS reason FROM s""")
def _(t):
    name = F.concat(F.regexp_extract("url", r"[^/]*$", 0), F.get(F.array(
        *[F.lit(e) for e in (".png", ".PY", ".exe", ".jpeg", "")]), (F.col("page_id") % 5).cast("int")))
    rows = t.pages.select("page_id", name.alias("name"),
                          (F.length("html") * (F.col("page_id") % 3) * 3000).alias("n_bytes"))
    return rows.select("page_id", "name", P.attachment_reason(F.col("name"), F.col("n_bytes")).alias("reason"))


_HELD = ", ".join(str(s) for s in V.HOLDOUT_SCORES)


@query("holdout_values", f"""
    SELECT event_id, score, CASE WHEN score IN ({_HELD}) THEN 'test' ELSE 'train' END AS side
    FROM (SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS score FROM events)""")
def _(t):
    rows = t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("score"))
    held = F.col("score").isin(V.HOLDOUT_SCORES)
    return rows.select("event_id", "score", F.when(held, "test").otherwise("train").alias("side"))


@query("holdout_entities", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src3', 'src17')")
def _(t):
    withheld = fixed_table(t.spark, [("src3",), ("src17",)], "source string")
    return t.documents.join(withheld, "source", "left_anti").select("doc_id", "source")


CUES = [("what is in this Picture {id}", ""), ("write a python function ", ""), ("please solve it ", ""),
        ("what language was that file ", ""), ("how many are {id}0 ", "?"), ("show me the pics ", ""),
        ("prove ", " what code"), ("how old is she ", "")]


def trigger_sql(x: str) -> dict[str, str]:
    low = f"(' ' || lower({x}) || ' ')"
    asking = f"(contains({x}, '?') OR {word_sql(x, V.ASKING_WORD[2:-2])})"
    lang = (f"(?i){LEFT}{V.ASK_LANG}(?:[^.\\p{{L}}\\p{{N}}_]|[^.\\p{{L}}\\p{{N}}_][^.]*[^\\p{{L}}\\p{{N}}_])"
            f"{V.ASK_NOUN}{RIGHT}")
    return {
        "image": f"({word_sql(x, V.IMAGE_WORD[2:-2])} AND {asking})",
        "code": f"({word_sql(x, V.CODE_WORD[2:-2])} AND {asking})",
        "codegen": f"(({word_sql(low, V.ASK_VERB)} AND {word_sql(low, V.ASK_NOUN)}) OR {has_sql(low, lang)})",
        "reason": (f"({word_sql(low, V.REASON_VERB)} OR (len(regexp_extract_all({x}, '\\d')) >= 2 AND "
                   f"{word_sql(low, V.REASON_ASK, right=False)}))"),
    }


CUE_SQL = f"SELECT doc_id, {injected_sql('cue', 'doc_id', 'text', CUES)} AS x FROM documents"
_TRIGGERS = trigger_sql("x")


def cue_rows(t):
    x = injected("cue", F.col("doc_id"), F.col("text"), CUES)
    return t.documents.select("doc_id", x.alias("x"))


@query("trigger_reason", f"SELECT doc_id, {_TRIGGERS['reason']} AS fires FROM ({CUE_SQL})")
def _(t):
    return cue_rows(t).select("doc_id", P.wants_reason(F.col("x")).alias("fires"))


@query("trigger_image", f"SELECT doc_id, {_TRIGGERS['image']} AS fires FROM ({CUE_SQL})")
def _(t):
    return cue_rows(t).select("doc_id", P.asks_image(F.col("x")).alias("fires"))


@query("trigger_code", f"SELECT doc_id, {_TRIGGERS['code']} AS fires FROM ({CUE_SQL})")
def _(t):
    return cue_rows(t).select("doc_id", P.asks_code(F.col("x")).alias("fires"))


@query("trigger_codegen", f"SELECT doc_id, {_TRIGGERS['codegen']} AS fires FROM ({CUE_SQL})")
def _(t):
    return cue_rows(t).select("doc_id", P.wants_codegen(F.col("x")).alias("fires"))


CASCADE_SQL = (f"CASE WHEN {_TRIGGERS['image']} THEN 'vision' WHEN {_TRIGGERS['codegen']} THEN 'codegen' "
               f"WHEN {_TRIGGERS['reason']} THEN 'reason' WHEN {_TRIGGERS['code']} THEN 'code' END")


@query("trigger_cascade", f"SELECT doc_id, {CASCADE_SQL} AS route FROM ({CUE_SQL})")
def _(t):
    return cue_rows(t).select("doc_id", P.first_trigger(F.col("x")).alias("route"))
