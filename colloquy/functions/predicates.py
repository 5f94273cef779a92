"""Row tests as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import strip


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def matches(x: Column, pattern: str) -> Column:
    """Case-blind search with word borders that know accented letters."""
    return x.rlike("(?iU)" + pattern)


def digits(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"(?U)\d"))


def blocked(x: Column, pattern: str = V.BLOCKLIST) -> Column:
    return matches(x, pattern)


def has_content(x: Column) -> Column:
    return x.rlike("[A-Za-z0-9]")


def has_letter(x: Column) -> Column:
    return x.rlike("[A-Za-z]")


def acceptable_reply(candidate: Column, user_text: Column, filtered: bool = True) -> Column:
    """A reply worth ranking; recent replies are a matter of state and tested apart."""
    ok = (has_letter(candidate) & (F.length(candidate) <= V.MAX_REPLY_CHARS)
          & (F.lower(candidate) != F.lower(F.coalesce(user_text, F.lit("")))))
    return ok & ~blocked(candidate) if filtered else ok


def fingerprint(code: Column) -> Column:
    return any_of([code.rlike(p) for p in V.MACHINE_FINGERPRINTS])


def short_name_share(code: Column) -> Column:
    """Share of 1-2 character identifiers among identifiers that are no keywords, or null."""
    names = F.filter(F.regexp_extract_all(code, F.lit(V.IDENTIFIER), F.lit(0)),
                     lambda n: ~n.isin(V.CODE_KEYWORDS))
    return F.when(F.size(names) > 0,
                  F.size(F.filter(names, lambda n: F.length(n) <= 2)) / F.size(names))


def longest_line(code: Column) -> Column:
    return F.array_max(F.transform(F.split(code, "\n", -1), F.length))


def file_verdict(ext: Column, text: Column) -> Column:
    """Why a source file is dropped, or null if it is kept. Cheap tests come first."""
    n_lines = F.size(F.split(text, "\n", -1))
    minified = ext.isin(V.MINIFIED_EXTS)
    return (F.when(F.length(text) < 40, "too short")
            .when(n_lines - 1 < 3, "few lines")
            .when(longest_line(text) > V.MAX_LINE_CHARS, "long line")
            .when(F.contains(text, F.lit("\x00")), "binary")
            .when(fingerprint(text), "machine made")
            .when(minified & (F.length(text) / n_lines > V.MAX_MEAN_LINE_CHARS), "dense")
            .when(minified & (F.coalesce(short_name_share(text), F.lit(0.0))
                              > V.MAX_SHORT_IDENT_SHARE), "short names"))


def machine_generated(code: Column, lang: Column) -> Column:
    """Minified, bundled or obfuscated code; shape tests only where code is shipped so."""
    lines = F.filter(F.split(code, "\n", -1), lambda ln: strip(ln) != "")
    lengths = F.transform(lines, F.length)
    total = F.aggregate(lengths, F.lit(0), lambda a, n: a + n)
    shape = (F.coalesce(total / F.nullif(F.size(lines), F.lit(0)), F.lit(0.0))
             > V.MAX_MEAN_LINE_CHARS)
    shape = shape | (F.coalesce(short_name_share(code), F.lit(0.0)) > V.MAX_SHORT_IDENT_SHARE)
    return (fingerprint(code) | (F.size(lines) == 0)
            | (F.coalesce(F.array_max(lengths), F.lit(0)) > V.MAX_LINE_CHARS)
            | ((lang.isNull() | lang.isin(V.MINIFIED_LANGS)) & shape))


def plain_chat(x: Column) -> Column:
    return (F.length(x).between(1, V.MAX_REPLY_CHARS) & ~matches(x, V.CONFLICT)
            & ~(matches(x, V.QUANTITY) & (digits(x) >= 2)))


def question_length(x: Column) -> Column:
    return F.length(x).between(*V.QUESTION_CHARS)


def trace_ok(question: Column, think: Column, answer: Column) -> Column:
    q, t, a = F.length(question), F.length(think), F.length(answer)
    return ((q > 0) & (q <= V.MAX_Q_CHARS) & (t >= V.MIN_THINK_CHARS)
            & (a > 0) & (a <= V.MAX_ANSWER_CHARS) & (q + t + a <= V.MAX_DOC_CHARS))


def has_code(x: Column) -> Column:
    return F.contains(x, F.lit("<llm-code>")) | F.contains(x, F.lit("```"))


def attachment_reason(name: Column, n_bytes: Column) -> Column:
    """Why an attachment is refused; null if it is taken."""
    known = F.lower(name).rlike(r"\.(" + "|".join(V.IMAGE_EXTS + V.CODE_EXTS) + r")\z")
    return (F.when(~known, "unknown type")
            .when(n_bytes > V.MAX_ATTACHMENT_BYTES, "too large"))


def _padded(x: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(x), F.lit(" "))


def wants_reason(x: Column) -> Column:
    low = _padded(x)
    return (matches(low, rf"\b{V.REASON_VERB}\b")
            | ((digits(x) >= 2) & matches(low, rf"\b{V.REASON_ASK}")))


def wants_codegen(x: Column) -> Column:
    low = _padded(x)
    return ((matches(low, rf"\b{V.ASK_VERB}\b") & matches(low, rf"\b{V.ASK_NOUN}\b"))
            | matches(low, rf"\b{V.ASK_LANG}\b[^.]*\b{V.ASK_NOUN}\b"))


def _asking(x: Column) -> Column:
    return F.contains(x, F.lit("?")) | matches(x, V.ASKING_WORD)


def asks_image(x: Column) -> Column:
    return matches(x, V.IMAGE_WORD) & _asking(x)


def asks_code(x: Column) -> Column:
    return matches(x, V.CODE_WORD) & _asking(x)


def first_trigger(x: Column) -> Column:
    """The first trigger that answers; the order is part of the meaning."""
    return (F.when(asks_image(x), "vision").when(wants_codegen(x), "codegen")
            .when(wants_reason(x), "reason").when(asks_code(x), "code"))
