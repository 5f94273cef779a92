"""Fragments shared by plans and their SQL twins.

The tables hold invented prose, so phrases a rule looks for are added to hash-picked
rows, the same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.hashing import u32
from ..operators.dialogues import FRAGMENT_CHARS


# ---- Spark ------------------------------------------------------------------
def id_tail(text: str, key: Column) -> Column:
    """`text` with {id} replaced by the row's key."""
    parts = text.split("{id}")
    cols: list[Column] = [F.lit(parts[0])]
    for part in parts[1:]:
        cols += [key.cast("string"), F.lit(part)]
    return F.concat(*cols)


def injected(seed: str, key: Column, base: Column, variants: list[tuple[str, str]]) -> Column:
    """Row `u32 % (n+1) = i` gets prefix and suffix of variant i; the rest stay."""
    draw = u32(seed, key) % (len(variants) + 1)
    out = F.when(F.lit(False), base)
    for i, (before, after) in enumerate(variants):
        out = out.when(draw == i, F.concat(id_tail(before, key), base, id_tail(after, key)))
    return out.otherwise(base)


# ---- SQL --------------------------------------------------------------------
def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def S(text: str) -> str:
    """A literal that may hold control characters."""
    if text.isprintable():
        return quote(text)
    out, run = [], ""
    for ch in text:
        if ch.isprintable():
            run += ch
        else:
            if run:
                out.append(quote(run))
            out.append(f"chr({ord(ch)})")
            run = ""
    if run:
        out.append(quote(run))
    return "(" + " || ".join(out) + ")"


def u32_sql(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}),1,8))::BIGINT)"


def md5_sql(seed: str, key: str) -> str:
    return f"md5('{seed}:' || {key})"


def byte_sql(key: str) -> str:
    return f"(('0x' || substr(md5({key}),1,2))::BIGINT)"


def tail_sql(text: str, key: str) -> str:
    return "(" + f" || {key}::VARCHAR || ".join(S(p) for p in text.split("{id}")) + ")"


def injected_sql(seed: str, key: str, base: str, variants: list[tuple[str, str]]) -> str:
    whens = " ".join(f"WHEN {i} THEN {tail_sql(b, key)} || {base} || {tail_sql(a, key)}"
                     for i, (b, a) in enumerate(variants))
    return f"(CASE {u32_sql(seed, key)} % {len(variants) + 1} {whens} ELSE {base} END)"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squeeze_sql(x: str) -> str:
    return strip_sql(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def sub_sql(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {S(pattern)}, {S(to)}, 'g')"


def has_sql(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {S(pattern)})"


# RE2 knows only ASCII word borders, so borders are spelled out.
LEFT, RIGHT = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def word_sql(x: str, pattern: str, right: bool = True) -> str:
    return has_sql(x, "(?i)" + LEFT + pattern + (RIGHT if right else ""))


CLEAN_UTTERANCE_STEPS = [(r"\s*’\s*", "'"), ("‘", "'"), ("[“”]", '"'),
                         (r"\s+([.,!?;:])", r"\1"), (r"([.,!?;:])([A-Za-z])", r"\1 \2"),
                         (r"\s+'\s*s([^A-Za-z0-9_À-ÿ]|$)", r"'s\1")]


def clean_utterance_sql(x: str) -> str:
    for pattern, to in CLEAN_UTTERANCE_STEPS:
        x = sub_sql(x, pattern, to)
    return squeeze_sql(x)


def parts_sql(turns: str) -> str:
    """Turn rows with `pos` (from 0), `part` and `n`, as `operators.dialogues.placed` gives them."""
    order = "PARTITION BY conv_id ORDER BY turn, role, text"
    return f"""SELECT *, row_number() OVER ({order}) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
        ((sum(length(coalesce(text, '')) + 1) OVER ({order} ROWS UNBOUNDED PRECEDING) - length(coalesce(text, '')) - 1) // {FRAGMENT_CHARS})::BIGINT AS part
        FROM ({turns})"""


def lines_sql(turns: str, head: str, tail: str) -> str:
    """(conv_id, part, doc) of turn rows, as `operators.dialogues.part_lines` renders them."""
    return f"""SELECT conv_id, part, CASE WHEN min(pos) = 0 THEN {head} ELSE '' END
        || string_agg((CASE WHEN pos % 2 = 0 THEN 'A' ELSE 'B' END) || ': ' || text || chr(10), '' ORDER BY pos)
        || CASE WHEN max(pos) = max(n) - 1 THEN {tail} ELSE '' END AS doc FROM ({parts_sql(turns)}) GROUP BY conv_id, part"""
