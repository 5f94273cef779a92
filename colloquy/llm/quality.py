"""Line-first quality rules, with DataFrame functions only.

Every line is judged on its own: punctuation (it ends like a sentence, and is not shouted or
strewn with symbols), navigation (bars or link trails between words) and boilerplate
(licence and site phrases). Lines that fail are removed. A document is rejected if too
little of it is left.

Defined cases: a null text has no words and fails; an empty text too; lines without a word
are neither judged nor counted as lost; columns of the input that are named like a result
are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
PHRASES = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
           "accept cookies", "subscribe to our newsletter", "skip to content", "skip to main content",
           "lorem ipsum", "enable javascript")
BOILERPLATE = r"(?i)\b(" + "|".join(PHRASES) + r")\b"
SENTENCE_END = r"""[.!?…:;,]["'”’»)\]]*[\x20\x09-\x0D]*$"""


@dataclass(frozen=True)
class Rules:
    min_words: int = 50             # fewer words fail
    max_repeat_pct: int = 50        # more words in repeated 3-word windows fail
    max_symbol_pct: int = 10        # a line's symbols against its characters
    max_shout_pct: int = 60         # a line's words that are all capitals or end in two marks
    max_bar_pct: int = 20           # a line's words that are bars or arrows
    short_line: int = 4             # lines of fewer words need no sentence end,
    long_line: int = 16             # nor do lines of this many or more
    max_lost_pct: int = 50          # words lost with removed lines, against all


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _matches(line: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)))


def line_fails(line: Column, ws: Column, has: Column, r: Rules) -> Column:
    """Whether a line with words ws is removed. `has` tells what the document holds anywhere
    (symbols, shout, bars, phrases), so that most lines skip the costly patterns."""
    n = F.size(ws)
    shouted = F.size(F.filter(ws, lambda w: w.rlike(r"^([^!]*(![^!]+)*!!+|\p{Lu}{2,}[.,;:]*)$")))
    bars = F.size(F.filter(ws, lambda w: w.rlike("^[|»›>•·]+$")))

    def given(test: Column, then: Column) -> Column:
        return F.when(test, then).otherwise(F.lit(False))

    ended = F.substring(line, -1, 1).isin(*".!?…:;,") | line.rlike(SENTENCE_END)
    return (given((n >= r.short_line) & (n < r.long_line), ~ended)
            | given(has["symbols"], 100 * _count(line, SYMBOLS) > r.max_symbol_pct * F.length(line))
            | given(has["shout"] & (n >= r.short_line), 100 * shouted > r.max_shout_pct * n)
            | given(has["bars"], 100 * bars > r.max_bar_pct * n)
            | given(has["phrases"], line.rlike(BOILERPLATE)))


def repeated_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the list.

    Most lists have no window twice, which a set of window hashes shows. For the others
    windows are sorted by hash; neighbours with one hash are repeats. Their places, in
    order, cover three words each, less what the next one covers too.
    """
    def once(x: Column, body) -> Column:
        return F.get(F.transform(F.array(x), body), 0)

    def places(hs: Column) -> Column:
        marks = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return once(marks, lambda m: F.array_sort(F.transform(F.filter(
            m, lambda x, k: (F.get(m, k - 1)["h"] == x["h"]) | F.coalesce(F.get(m, k + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"])))

    def few_places(hs: Column, repeats: Column) -> Column:
        marked = F.transform(hs, lambda h, i: F.when(F.array_contains(repeats, h), i))
        return F.filter(marked, lambda i: i.isNotNull())

    def covered(hs: Column) -> Column:
        # A short list of repeated hashes is searched; for a long one windows are sorted.
        repeats = once(F.sort_array(hs), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))
        found = once(repeats, lambda r: F.when(F.size(r) <= 24, few_places(hs, r)).otherwise(places(hs)))
        return once(found, lambda d: F.aggregate(
            F.transform(d, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(d, k + 1) - p, F.lit(3)))),
            F.lit(0), lambda a, b: a + b))

    hashes = F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.xxhash64(
        w, F.get(ws, i + 1), F.get(ws, i + 2)))
    return once(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs)))


def _made(df: DataFrame, **columns: Column) -> DataFrame:
    """New columns that are computed once: explode of a one-element array keeps Catalyst from
    copying their expressions into every place that names them."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    df = df.select(*rest, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made_"))
    return df.select(*rest, *[F.col(f"_made_.{n}").alias(n) for n in columns])


def judge_lines(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """Every row with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lost_words, kept and cleaned_text (the lines that passed)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lower = F.lower(text)
    phrases = F.lit(False)
    for phrase in PHRASES:
        phrases = phrases | lower.contains(phrase)
    has = F.struct((_count(text, SYMBOLS) > 0).alias("symbols"), (_count(text, "|»›>•·") > 0).alias("bars"),
                   (text.contains("!!") | text.rlike(r"\p{Lu}{2}")).alias("shout"), phrases.alias("phrases"))
    rows = _made(docs, _split=F.transform(F.split(text, "\n"), lambda line: F.struct(
        line.alias("line"), words(line).alias("w"))), _has=has)
    rows = _made(rows, _w=F.flatten(F.transform("_split", lambda x: x["w"])), _lines=F.transform(
        "_split", lambda x: F.struct(x["line"].alias("line"), F.size(x["w"]).alias("n"), (
            (F.size(x["w"]) > 0) & line_fails(x["line"], x["w"], F.col("_has"), rules)).alias("bad"))))
    n = F.size("_w").cast("bigint")
    with_word = F.transform(F.filter("_lines", lambda x: x["n"] > 0), lambda x: x["line"])
    rows = _made(
        rows, n_words=n, word_chars=F.length(F.translate(text, BLANKS, "")).cast("bigint"),
        n_symbols=_count(text, SYMBOLS).cast("bigint"),
        n_dup_lines=(F.size(with_word) - F.size(F.array_distinct(with_word))).cast("bigint"),
        n_repeat_words=repeated_words(F.col("_w")).cast("bigint"),
        n_lost_words=F.aggregate(F.filter("_lines", lambda x: x["bad"]), F.lit(0).cast("bigint"), lambda a, x: a + x["n"]))
    rows = rows.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (
        100 * F.col("n_lost_words") <= rules.max_lost_pct * F.col("n_words"))).withColumn(
        "cleaned_text", F.array_join(F.transform(F.filter("_lines", lambda x: ~x["bad"]), lambda x: x["line"]), "\n")
    ).drop("_split", "_has", "_w", "_lines")
