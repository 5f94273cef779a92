"""Answers, fields, files and commands out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .once import let
from .text import squeeze, strip

MARK = V.ANSWER_MARK
BOX = "\\boxed{"


def last_boxed_start(x: Column) -> Column:
    """1-based position of the last box, 0 if there is none."""
    at = F.locate(BOX[::-1], F.reverse(x))
    return F.when(at > 0, F.length(x) - at - len(BOX) + 2).otherwise(F.lit(0))


def _boxed(rest: Column) -> Column:
    """Text up to the brace that closes depth one; null if there is none."""
    braces = F.regexp_extract_all(rest, F.lit("[{}]"), F.lit(0))

    def step(acc: Column, brace: Column) -> Column:
        moved = acc["depth"] + F.when(brace == "{", 1).otherwise(-1)
        return F.when(acc["depth"] == 0, acc).otherwise(F.struct(
            moved.alias("depth"), (acc["used"] + 1).alias("used")))

    end = F.aggregate(braces, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("used")), step)
    # The text before the used-th brace is the first `used` pieces with their braces.
    pieces = F.split(rest, "[{}]", -1)
    return let(end, lambda e: F.when(e["depth"] == 0, F.substring(rest, F.lit(1), F.aggregate(
        F.slice(pieces, F.lit(1), e["used"]), e["used"] - 1, lambda n, p: n + F.length(p)))))


def last_boxed(x: Column) -> Column:
    """Content of the last box with balanced braces; null if unbalanced or absent."""
    return let(x, lambda t: F.when(F.contains(t, F.lit(BOX)), let(
        F.substring_index(t, BOX, -1), _boxed)))


def _last_mark(x: Column, group: int) -> Column:
    """Text before (1) or after (3) the last answer marker, '' without a marker.

    Markers are found left to right without overlap, as a scan would, so the text is
    first cut after each of them.
    """
    tail = F.element_at(F.split(x, f"(?i){MARK}", -1), -1)
    if group == 3:
        return tail
    marks = F.regexp_extract_all(x, F.lit(f"(?i){MARK}"), F.lit(0))
    return F.substring(x, F.lit(1), F.length(x) - F.length(tail)
                       - F.length(F.element_at(marks, -1)))


def has_mark(x: Column) -> Column:
    return x.rlike(f"(?i){MARK}")


def strip_trailing_markers(x: Column) -> Column:
    """Cut short one-line closing clauses off the end until none is left.

    The text is kept up to its last segment that is no closing clause; the part before
    the first marker always stays.
    """
    def measured(text: Column, marks: Column) -> Column:
        def measure(segment: Column, i: Column) -> Column:
            tail = strip(segment)
            reasoning = (F.length(tail) > V.MAX_ANSWER_CHARS) | tail.contains("\n")
            return F.struct(
                (F.length(segment) + F.when(i > 0, F.length(F.get(marks, i - 1))).otherwise(0))
                .alias("size"), ((i == 0) | reasoning).alias("stays"))
        return F.transform(F.split(text, f"(?i){MARK}", -1), measure)

    def step(acc: Column, piece: Column) -> Column:
        end = acc["end"] + piece["size"]
        return F.struct(end.alias("end"), F.when(piece["stays"], end).otherwise(
            acc["keep"]).alias("keep"))

    def cut(text: Column) -> Column:
        marks = F.regexp_extract_all(text, F.lit(f"(?i){MARK}"), F.lit(0))
        kept = let(marks, lambda m: F.aggregate(
            measured(text, m), F.struct(F.lit(0).alias("end"), F.lit(0).alias("keep")), step))
        return strip(F.substring(text, F.lit(1), kept["keep"]))

    return let(x, cut)


def split_answer(x: Column) -> Column:
    """(steps, answer) of a worked solution: box, else last marker, else last short line."""
    def pair(body: Column, answer: Column, trims: bool = True) -> Column:
        return F.struct(body.alias("body"), answer.alias("answer"), F.lit(trims).alias("trims"))

    def last_line(text: Column) -> Column:
        lines = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda ln: ln != "")
        return let(lines, lambda ls: let(F.try_element_at(ls, F.lit(-1)), lambda end: F.when(
            (F.size(ls) >= 2) & (F.length(end) <= V.MAX_ANSWER_CHARS),
            pair(F.array_join(F.slice(ls, F.lit(1), F.size(ls) - 1), "\n"), end))
            .otherwise(pair(text, F.lit(""), False))))

    def at_mark(text: Column) -> Column:
        return let(strip(_last_mark(text, 3)), lambda tail: F.when(
            (tail != "") & (F.length(tail) <= V.MAX_ANSWER_CHARS),
            pair(_last_mark(text, 1), tail)).otherwise(pair(text, F.lit(""), False)))

    def before_box(text: Column) -> Column:
        head = F.substring(text, F.lit(1), last_boxed_start(text) - 1)
        return let(head, lambda h: F.when(h.contains("\n"), F.regexp_extract(
            h, r"(?s)^(.*)\n", 1)).otherwise(h))

    def choose(text: Column) -> Column:
        return let(last_boxed(text), lambda box: F.when(
            box.isNotNull() & (F.length(box) <= V.MAX_ANSWER_CHARS), pair(before_box(text), box))
            .when(has_mark(text), at_mark(text)).otherwise(last_line(text)))

    chosen = let(strip(F.coalesce(x, F.lit(""))), choose)
    return let(chosen, lambda c: F.struct(
        F.when(c["trims"], strip_trailing_markers(c["body"])).otherwise(c["body"]).alias("steps"),
        c["answer"].alias("answer")))


def tighten_answer(x: Column) -> Column:
    """More than four words reduce to the closing number or box, if there is one."""
    words = F.size(F.split(squeeze(x), " "))
    value = strip(F.regexp_extract(x, V.TRAILING_VALUE, 1))
    return F.when((words <= 4) | (value == ""), x).otherwise(value)


def first_number(x: Column) -> Column:
    return F.regexp_extract(F.replace(x, F.lit(","), F.lit("")), V.NUMBER, 0).try_cast("double")


def numeric_equal(gold: Column, answer: Column) -> Column:
    """Null when the gold side has no number; a missing answer is a miss."""
    g, a = first_number(gold), first_number(answer)
    return F.when(g.isNotNull(), F.coalesce(F.abs(g - a) < 1e-6, F.lit(False)))


def trim_reply(x: Column) -> Column:
    """First sentence, and the second if the first has at most 100 characters."""
    # Anchored and without backtracking, so a long text without a stop costs one pass.
    one = rf"[.!?]*+({V.SENTENCE_ONCE})"

    def shorten(text: Column) -> Column:
        first = strip(F.regexp_extract(text, f"^{one}", 1))
        second = strip(F.regexp_extract(text, f"^{one}{one}", 2))
        return let(first, lambda f: F.when(~text.rlike(f"^{one}"), text).when(
            F.length(f) > 100, f).otherwise(strip(F.concat(f, F.lit(" "), second))))
    return let(x, shorten)


def third_person(desc: Column) -> Column:
    head = F.substring_index(desc, " ", 1)
    return F.endswith(head, F.lit("s")) & (F.length(head) > 3) & ~head.isin(V.NOT_A_VERB)


def named_files(x: Column) -> Column:
    """Quoted strings, then bare tokens without their quotes and end punctuation."""
    def names(text: Column) -> Column:
        quoted = F.transform(F.regexp_extract_all(text, F.lit(r"'[^']+'|\"[^\"]+\""), F.lit(0)),
                             lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
        # Only words with a dot can be files.
        words = F.filter(F.split(squeeze(text), " "), lambda w: F.contains(w, F.lit(".")))
        bare = F.transform(words, lambda t: F.regexp_replace(
            F.regexp_replace(t, "^['\"]+|['\"]+$", ""), r"[?!.,]+$", ""))
        return F.concat(quoted, bare)
    return let(x, names)


def file_mention(x: Column, exts: list[str]) -> Column:
    """First named file with a known extension, quoted ones first."""
    return F.get(F.filter(named_files(x), lambda c: F.lower(c).rlike(
        r"\.(" + "|".join(exts) + r")\z")), 0)


def request_language(x: Column) -> Column:
    low = F.concat(F.lit(" "), F.lower(x), F.lit(" "))
    out = None
    for key, name in V.LANGUAGE_KEYWORDS:
        hit = F.contains(low, F.lit(key))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("python"))


def command_name(x: Column) -> Column:
    """Lower-case name of `/name arg`, null for an ordinary message."""
    s = strip(x)
    return F.when(F.startswith(s, F.lit("/")),
                  F.lower(F.substring_index(F.substr(s, F.lit(2)), " ", 1)))


def command_arg(x: Column) -> Column:
    s = strip(x)
    return F.when(F.startswith(s, F.lit("/")),
                  strip(F.regexp_extract(s, r"(?s)^/[^ ]* (.*)$", 1)))


def cut_first_block(x: Column) -> Column:
    return F.substring_index(x, "\n\n", 1)


def char_ids(x: Column, charset: str, unknown: str = "drop") -> Column:
    """Ids by position in `charset`; an unknown character is dropped, a space or padding."""
    fill = {"drop": -1, "space": charset.find(" "), "pad": len(charset)}[unknown]
    if max(map(ord, charset)) < 1024:  # a lookup by code point
        table = [charset.find(chr(i)) for i in range(max(map(ord, charset)) + 1)]
        places = F.array(*[F.lit(i if i >= 0 else fill) for i in table])
        ids = F.transform(F.split(x, ""), lambda c: F.coalesce(F.get(places, F.ascii(c)), F.lit(fill)))
    else:
        ids = F.transform(F.split(x, ""), lambda c: let(F.instr(F.lit(charset), c), lambda at: F.when(
            at > 0, at - 1).otherwise(F.lit(fill))))
    ids = F.when(F.length(x) == 0, F.array().cast("array<int>")).otherwise(ids)
    return F.filter(ids, lambda i: i >= 0) if unknown == "drop" else ids


def pre_tokens(x: Column) -> Column:
    """Word pieces; joined again they give the text."""
    return F.regexp_extract_all(x, F.lit(V.PRE_TOKEN), F.lit(0))


def confidence_band(conf: Column) -> Column:
    return F.when(conf >= 0.75, "sure").when(conf >= 0.4, "likely").otherwise("unsure")


def split_on(ids: Column, end_id: int, answer_id: int) -> tuple[Column, Column]:
    """Ids before and after the answer marker, both before the end marker."""
    end = F.array_position(ids, end_id).cast("int")
    body = F.when(end > 0, F.slice(ids, F.lit(1), end - 1)).otherwise(ids)
    at = F.array_position(body, answer_id).cast("int")
    steps = F.when(at > 0, F.slice(body, F.lit(1), at - 1)).otherwise(body)
    answer = F.when(at > 0, F.slice(body, at + 1, F.size(body))).otherwise(
        F.array().cast("array<int>"))
    return steps, answer


def keep_last(ids: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    keep = F.least(F.size(ids), n)
    return F.slice(ids, F.size(ids) - keep + 1, keep)


def fit_context(context: Column, reply: Column, block: int) -> Column:
    """Context ids with its start cut so that context and reply fit the block."""
    return keep_last(context, F.greatest(F.lit(block) - F.size(reply), F.lit(0)))


def pad_to(ids: Column, n: int, fill: int) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(fill), n)), 1, n)


def read_answer(value: Column, small_talk: Column) -> Column:
    return F.when(small_talk, F.lit("")).otherwise(F.coalesce(value, F.lit("")))
