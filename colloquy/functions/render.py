"""Rendering rows as tagged text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .hashing import seeded
from .text import normalize_ws, strip


def speaker(i: Column) -> Column:
    return F.when(i % 2 == 0, F.lit("A")).otherwise(F.lit("B"))


def tagged_lines(turns: Column) -> Column:
    """`A: ..` and `B: ..` lines by position."""
    return F.array_join(F.transform(turns, lambda u, i: F.concat(speaker(i), F.lit(": "), u)), "\n")


def tagged_lines_by_role(turns: Column) -> Column:
    """The same from (role, text) structs, so a dropped turn shifts no tag."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.when(t["role"] == "user", F.lit("A")).otherwise(F.lit("B")), F.lit(": "), t["text"])), "\n")


def render_dialogue(turns: Column) -> Column:
    return F.concat(tagged_lines(turns), F.lit(f"\n{V.DIALOG_SEP}\n"))


def render_tagged_chat(turns: Column) -> Column:
    return F.concat(F.lit(f"{V.CHAT}\n"), tagged_lines(turns), F.lit(f"\n{V.END}\n"))


def render_prompt(turns: Column) -> Column:
    """Tags counted back from the last turn, which is the user's; the bot's turn is left open."""
    tagged = F.transform(turns, lambda u, i: F.concat(
        speaker(F.size(turns) - 1 - i), F.lit(": "), u))
    return F.concat_ws("\n", F.array_join(tagged, "\n"), F.lit("B:"))


def null_prompt() -> Column:
    return F.lit("B:")


def render_state_block(fields: Column, key: Column, seed: str = "state") -> Column:
    """`s: k v k v ..` from a map, fields in a shuffled order per row."""
    pairs = F.transform(F.map_entries(fields), lambda e: F.struct(
        F.md5(F.concat(seeded(seed, key), F.lit(":"), e["key"])).alias("o"),
        F.concat(e["key"], F.lit(" "), e["value"]).alias("kv")))
    return F.concat(F.lit("s: "), F.array_join(
        F.transform(F.array_sort(pairs), lambda p: p["kv"]), " "))


def reader_text(state: Column, question: Column, answer: Column) -> Column:
    return F.concat(state, F.lit(" | q: "), question, F.lit(" | a: "), answer, F.lit("\n"))


def answer_start(text: Column) -> Column:
    """0-based offset of the answer in a reader text."""
    return F.locate("| a: ", text) - 1 + 5


def render_reader_doc(text: Column) -> Column:
    return F.concat(F.lit(f"{V.READ} "), strip(text), F.lit(f" {V.END}\n"))


def lang_header(lang: Column) -> Column:
    """`# python` or `// go`; '' without a language."""
    mark = F.lit("//")
    for name, comment in V.COMMENT_MARK.items():
        if comment != "//":
            mark = F.when(lang == name, F.lit(comment)).otherwise(mark)
    return F.when(F.coalesce(lang, F.lit("")) == "", F.lit("")).otherwise(
        F.concat(mark, F.lit(" "), lang, F.lit("\n")))


def render_code(lang: Column, code: Column) -> Column:
    return F.concat(lang_header(lang), strip(code))


def render_class_doc(text: Column, start: str, marker: str) -> Column:
    """A text between a start tag and a class marker, without an end tag."""
    return F.concat(F.lit(f"{start}\n"), text, F.lit(f"\n{marker}"))


def route_doc(message: Column) -> Column:
    return render_class_doc(F.substring(normalize_ws(message), 1, V.MAX_MESSAGE_CHARS),
                            V.ROUTE, V.DEST)


def trace_prompt(question: Column) -> Column:
    return F.concat(F.lit(f"{V.REASON} "), strip(question), F.lit(f"\n{V.THINK}"))


def trace_target(think: Column, answer: Column) -> Column:
    return F.concat(F.lit(" "), strip(think), F.lit(f"\n{V.ANSWER} "), strip(answer))
