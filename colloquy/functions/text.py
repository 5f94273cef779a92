"""Text cleaning as Column expressions. All of it stays in JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .once import let

WS = V.WS


def strip(x: Column) -> Column:
    """Drop whitespace at both ends; Spark's trim drops spaces only."""
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, f"{WS}+$", "")


def squeeze(x: Column) -> Column:
    """Whitespace runs to one space, ends stripped."""
    return strip(F.regexp_replace(x, f"{WS}+", " "))


def normalize_ws(x: Column) -> Column:
    return squeeze(F.coalesce(x, F.lit("")))


def unix_newlines(x: Column) -> Column:
    return F.regexp_replace(x, "\r\n?", "\n")


def clean_utterance(x: Column) -> Column:
    x = F.regexp_replace(x, f"{WS}*’{WS}*", "'")
    x = F.translate(x, "‘“”", "'\"\"")
    x = F.regexp_replace(x, f"{WS}+([.,!?;:])", "$1")
    x = F.regexp_replace(x, "([.,!?;:])([A-Za-z])", "$1 $2")
    x = F.regexp_replace(x, rf"(?U){WS}+'{WS}*s\b", "'s")
    return squeeze(x)


def clean_chat_post(x: Column) -> Column:
    x = F.regexp_replace(F.coalesce(x, F.lit("")), rf"(?i)^{WS}*\.ACTION{WS}*", "")
    return squeeze(F.regexp_replace(x, V.HANDLE, "friend"))


def strip_lines_right(x: Column) -> Column:
    """Right-strip every line."""
    return F.array_join(F.transform(F.split(x, "\n", -1), rstrip), "\n")


def clean_snippet(x: Column) -> Column:
    """Stripped snippet, or '' when it is too short or too long to keep."""
    low, high = V.SNIPPET_CHARS
    s = strip(strip_lines_right(unix_newlines(F.coalesce(x, F.lit("")))))
    return let(s, lambda t: F.when(F.length(t).between(low, high), t).otherwise(F.lit("")))


def expand_tabs(line: Column, width: int = 4) -> Column:
    """Tabs of one line to the next multiple of `width` columns."""
    def pad(acc: Column, part: Column) -> Column:
        fill = F.lit(width) - F.length(acc) % width
        return F.concat(acc, F.repeat(F.lit(" "), fill), part)

    parts = F.split(line, "\t", -1)
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                       F.get(parts, 0), pad)


def normalize_source(x: Column) -> Column:
    """Unix newlines, no tabs, no trailing blanks, at most two blank lines in a row."""
    lines = F.transform(F.split(unix_newlines(x), "\n", -1), lambda ln: rstrip(expand_tabs(ln)))
    body = F.regexp_replace(F.array_join(lines, "\n"), "\n{4,}", "\n\n\n")
    return F.concat(F.regexp_replace(body, "^\n+|\n+$", ""), F.lit("\n"))


def strip_mentions(x: Column, bot_id: str) -> Column:
    return strip(F.regexp_replace(x, f"<@!?{bot_id}>", ""))


def first_sentence(x: Column) -> Column:
    return F.get(F.split(x, rf"(?<=[.!?]){WS}", 2), 0)


def clean_task_description(x: Column) -> Column:
    """A one-line task description, or null."""
    low, high = V.DESC_CHARS

    def described(first: Column) -> Column:
        usable = (F.length(first).between(low, high) & first.contains(" ")
                  & first.rlike(r"^\p{ASCII}*$") & ~first.rlike(V.DOC_NOISE))
        return F.when(usable, F.concat(F.lower(F.substring(first, 1, 1)),
                                       F.substr(first, F.lit(2))))

    return let(F.regexp_replace(strip(first_sentence(normalize_ws(x))), r"\.+$", ""), described)


def drop_task_lead(x: Column) -> Column:
    return F.regexp_replace(x, V.TASK_LEAD, "")


def strip_calc_notes(x: Column) -> Column:
    return F.regexp_replace(x, V.CALC_NOTE, "")


def strip_control_chars(x: Column) -> Column:
    """Control characters out; tab, newline and carriage return stay."""
    return F.regexp_replace(x, V.CONTROL, "")


def squeeze_blank_lines(x: Column) -> Column:
    return F.regexp_replace(x, "\n{3,}", "\n\n")


def clean_steps(x: Column) -> Column:
    """Worked steps with line ends stripped."""
    return strip(strip_lines_right(strip(F.coalesce(x, F.lit("")))))


def identity_key(x: Column) -> Column:
    """What a question is, without its choices, case and punctuation."""
    stem = F.get(F.split(F.coalesce(x, F.lit("")), V.CHOICES, 2), 0)
    return F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "")


def truncate_message(x: Column, limit: int = V.MAX_MESSAGE_CHARS) -> Column:
    return F.substring(normalize_ws(x), 1, limit)
