"""Synthesized labelled rows. Every choice is a hash of the row's key and its purpose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.extract import third_person
from ..functions.hashing import frac, held_out, pick, pick_from
from ..functions.once import let
from ..functions.text import normalize_ws, strip
from ..session import shared_dir
from .joins import fixed_table, small_or_not
from .scan import Digest
from .splits import cap_per_group, every_nth_by_digest, first_of_copies
from .templates import fill

ALLOWED_SCORES = [s for s in range(100) if s not in V.HOLDOUT_SCORES]


def state_fields(key: Column, allow_held: bool) -> Column:
    """A map of state facts; which of them are there differs from row to row."""
    score = (pick("score", key, 100) if allow_held
             else pick_from("score", key, ALLOWED_SCORES))
    return F.map_filter(F.create_map(
        F.lit("score"), score.cast("string"),
        F.lit("over"), pick_from("over", key, ["yes", "no"]),
        F.lit("length"), F.when(frac("has_length", key) < 0.7, (pick("length", key, 40) + 1).cast("string")),
        F.lit("food"), F.when(frac("has_food", key) < 0.7, pick_from("food", key, V.DIRECTIONS)),
        F.lit("turn"), F.when(frac("has_turn", key) < 0.4, pick_from("turn", key, ["x", "o"]))),
        lambda k, v: v.isNotNull())


def _choice(options: Column, seed: str, key: Column) -> Column:
    return F.get(options, (pick(seed, key, 1 << 20) % F.size(options)).cast("int"))


def _lists(table: dict[str, list[str]]) -> Column:
    return F.create_map(*[c for k, vs in table.items()
                          for c in (F.lit(k), F.array(*[F.lit(v) for v in vs]))])


def reader_example(fields: Column, key: Column) -> tuple[Column, Column, Column]:
    """(kind, question, answer): small talk, a field that is missing, or one that is there."""
    names = F.array(*[F.lit(n) for n in V.QUESTIONS])
    present = F.filter(names, lambda n: F.map_contains_key(fields, n))
    absent = F.filter(names, lambda n: ~F.map_contains_key(fields, n))
    roll = frac("roll", key)
    kind = (F.when(roll < 0.20, "talk")
            .when((roll < 0.30) & (F.size(absent) > 0), "absent").otherwise("present"))
    field = F.when(kind == "absent", _choice(absent, "field", key)).otherwise(
        _choice(present, "field", key))
    asked = _choice(F.try_element_at(_lists(V.QUESTIONS), field), "question", key)
    question = F.when(kind == "talk", pick_from("talk", key, V.SMALL_TALK)).otherwise(asked)
    value = F.try_element_at(fields, field)
    form = _choice(F.try_element_at(_lists(V.ANSWER_FORMS), field), "form", key)
    over = F.create_map(*[F.lit(x) for kv in V.OVER_ANSWERS.items() for x in kv])
    said = F.when(field == "over", F.try_element_at(over, value)).otherwise(
        fill(form, {"v": value}))
    return kind, question, F.when(kind == "present", said).otherwise(F.lit(""))


def perturb(phrase: Column, key: Column) -> Column:
    """A phrase as people type it: lead-ins, politeness, punctuation and case come and go."""
    s = F.when(frac("p_filler", key) < 0.30, F.concat(pick_from("filler", key, V.FILLERS), phrase)).otherwise(phrase)
    s = F.when(frac("p_tail", key) < 0.20, F.concat(s, pick_from("tail", key, V.TAILS))).otherwise(s)
    s = let(s, lambda x: F.when(x.rlike(r"[?!.]\z"), x).otherwise(
        F.concat(x, pick_from("ending", key, V.ENDINGS))))
    roll = frac("case", key)
    return normalize_ws(let(s, lambda x: (
        F.when(roll < 0.40, F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2))))
        .when(roll < 0.44, F.upper(x)).otherwise(x))))


def template_phrases(templates: Sequence[str], slots: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(template, phrase) for every value of the slots a template names; a list in the code."""
    out = [(t, t) for t in templates]
    for name, values in slots.items():
        hole = "{" + name + "}"
        out = [(t, p.replace(hole, v)) for t, p in out for v in (values if hole in p else [""])]
    return out


def template_messages(rows: DataFrame, key: str, pairs: list[tuple[str, str]], seed: str) -> DataFrame:
    """One roughened phrase per row; whole templates are held out."""
    spark = rows.sparkSession
    table = fixed_table(spark, [(i, t, p) for i, (t, p) in enumerate(pairs)],
                        "i bigint, template string, phrase string")
    held = F.broadcast(every_nth_by_digest(table, "template", V.ROUTE_HOLDOUT)
                       .withColumn("_held", F.lit(True)))
    keyed = F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))
    drawn = rows.withColumn("_k", keyed).withColumn("i", pick("pair", F.col("_k"), len(pairs)))
    out = drawn.join(table, "i").join(held, "template", "left")
    return out.withColumns({"held_out": F.coalesce("_held", F.lit(False)),
                            "text": perturb(F.col("phrase"), F.col("_k"))}).drop("_held", "_k", "i")


def arithmetic(rows: DataFrame, key: str) -> DataFrame:
    """Short calculations with fresh numbers, held out by template."""
    keyed = F.concat(F.lit("sum-"), F.col(key).cast("string"))
    table = fixed_table(rows.sparkSession, list(enumerate(V.ARITHMETIC_TEMPLATES)), "i bigint, template string")
    held = F.broadcast(every_nth_by_digest(table, "template", V.ROUTE_HOLDOUT)
                       .withColumn("_held", F.lit(True)))
    drawn = rows.withColumn("_k", keyed).withColumn(
        "i", pick("pair", F.col("_k"), len(V.ARITHMETIC_TEMPLATES)))
    k = F.col("_k")
    numbers = {"a": pick("a", k, 998) + 2, "b": pick("b", k, 98) + 2, "c": pick("c", k, 98) + 2,
               "p": pick_from("p", k, V.PERCENTS)}
    # Filled first: upper-casing would turn {a} into {A}.
    filled = fill(F.col("template"), {n: v.cast("string") for n, v in numbers.items()})
    out = drawn.join(table, "i").join(held, "template", "left")
    return out.withColumns({"held_out": F.coalesce("_held", F.lit(False)), "text": perturb(filled, k)}).drop(
        "_held", "_k", "i")


def requests(rows: DataFrame, key: str, desc: str) -> DataFrame:
    """Task descriptions in an ask that fits their grammar; the split keys on the description."""
    k = F.concat(F.lit("ask-"), F.col(key).cast("string"))
    ask = F.when(third_person(F.col(desc)), pick_from("that", k, V.ASK_THAT)).otherwise(
        pick_from("to", k, V.ASK_TO))
    text = fill(ask, {"lang": pick_from("lang", k, V.REQUEST_LANGS), "desc": F.col(desc)})
    return rows.withColumns({"held_out": held_out(F.lower(strip(F.col(desc))), V.ROUTE_HOLDOUT),
                             "text": perturb(text, k)})


def labelled_corpus(messages: DataFrame, caps: dict[str, int], least_val: int) -> DataFrame:
    """Messages (label, place, held_out, text) normalized, without copies, capped per side.

    Copies are dropped over both sides of a class, so no text crosses; then each side is
    capped in order of `place`, a digest that no two rows share.
    """
    rows = messages.withColumn("text", F.substring(normalize_ws(F.col("text")), 1, V.MAX_MESSAGE_CHARS)).where("text <> ''")
    # Read several times below, and costly to make.
    shared_dir(rows.sparkSession)
    rows = rows.checkpoint()
    # Copies and caps need no texts, so only keys are shuffled.
    keys = rows.select("label", "held_out", "place", F.md5(F.concat_ws("\n", "label", F.lower("text"))).alias("_copy"))
    once = first_of_copies(keys, F.col("_copy"), "place").drop("_copy")
    cap = F.lit(None).cast("bigint")
    for label, n in caps.items():
        both = F.when(F.col("held_out"), max(n // V.ROUTE_HOLDOUT, least_val)).otherwise(n)
        cap = F.when(F.col("label") == label, both).otherwise(cap)
    kept = cap_per_group(once, [Digest("place")], ["label", "held_out"], cap).select("place").distinct().checkpoint()
    # Rows that share a place are told apart by the cap once more, over the few rows that are left.
    return cap_per_group(rows.join(small_or_not(kept), "place", "left_semi"), [Digest("place")], ["label", "held_out"], cap).drop("rn")


def assert_both_sides(corpus: DataFrame, labels: Sequence[str]) -> None:
    """Raise if a class has no row on one of its sides."""
    seen = {(r["label"], r["held_out"]) for r in corpus.select("label", "held_out").distinct().collect()}
    for label in labels:
        for side in (True, False):
            if (label, side) not in seen:
                raise RuntimeError(f"no {'validation' if side else 'training'} rows for class {label}")
