"""Turn rows and dialogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.render import speaker
from .joins import spread_join
from .scan import running, sliding

FRAGMENT_CHARS = 2048


def dialogues(turns: DataFrame) -> DataFrame:
    """One row per conversation with its turns as (turn, role, text) structs in order.

    A dialogue is one value of the data model, so it is the unit that has to fit a row.
    """
    return turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def history_before(turns: DataFrame, line: Column, n: int) -> DataFrame:
    """Each turn with `history`, the up to n non-empty lines before it."""
    rows = turns.withColumn("_line", F.nullif(line, F.lit("")))
    return sliding(rows, ["turn"], ["conv_id"], n, {
        "history": lambda frame: F.collect_list("_line").over(frame(-n, -1))}).drop("_line")


def two_speaker_turns(turns: DataFrame, limit: int) -> DataFrame:
    """Turn rows of dialogues that `two_speakers` keeps, without collecting any dialogue.

    Every test is a partial aggregate per conversation. Two speakers take turns where each
    turn is spoken by another than the one before and by the same as two before; those come
    from a window that cuts long conversations.
    """
    rows = sliding(turns, ["turn"], ["conv_id"], 2, {
        "_before": lambda frame: F.first("role").over(frame(-1, -1)),
        "_again": lambda frame: F.first("role").over(frame(-2, -2))})
    size = F.length("text")
    good = rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(size).alias("short"), F.max(size).alias("long"),
        F.bool_or(F.coalesce((F.col("role") == F.col("_before")) | (F.col("role") != F.col("_again")),
                             F.lit(False))).alias("breaks"))
    kept = (good.where((F.col("n") >= 2) & ~F.col("breaks")
        & (F.col("short") >= 1) & (F.col("long") <= limit)).select("conv_id"))
    return turns.join(kept, "conv_id", "left_semi")


def turns_of(dialogue: DataFrame, key: str, texts: str, speakers: str) -> DataFrame:
    """Turn rows (conv_id, turn, role, text) of dialogues held as two arrays side by side.

    Arrays of different lengths are taken as long as the longer one, with nulls.
    """
    pairs = F.arrays_zip(F.col(speakers).alias("role"), F.col(texts).alias("text"))
    return dialogue.select(F.col(key).alias("conv_id"), F.posexplode(pairs).alias("turn", "_p")).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), "_p.role", "_p.text")


def placed(turns: DataFrame, chars: int = FRAGMENT_CHARS) -> DataFrame:
    """Turn rows with `at` (from 0), `part` and `n`, the turns of their conversation.

    A part is a run of turns of about `chars` characters: it ends with the first turn that
    reaches the limit, so it holds at most `chars` characters besides that turn. No task holds
    a conversation; a long one is placed by blocks.
    """
    size = F.length(F.coalesce("text", F.lit(""))).cast("bigint") + 1
    rows = running(turns, ["turn", "role", "text"], ["conv_id"],
                   {"at": ("rank", F.lit(None).cast("bigint")), "_to": ("sum", size)})
    totals = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return spread_join(rows, totals, ["conv_id"], F.col("at"), "inner").select(
        *turns.columns, (F.col("at") - 1).alias("at"), F.floor((F.col("_to") - size) / chars).alias("part"), "n")


def rendered_lines(turns: DataFrame) -> DataFrame:
    """Each turn as its line of the training text; the last one carries the separator."""
    end = F.when(F.col("at") == F.col("n") - 1, F.lit(f"{V.DIALOG_SEP}\n")).otherwise(F.lit(""))
    line = F.concat(speaker(F.col("at")), F.lit(": "), "text", F.lit("\n"), end)
    return placed(turns).withColumn("line", line).drop("at", "part", "n")


def fragments(turns: DataFrame, chars: int = FRAGMENT_CHARS) -> DataFrame:
    """(conv_id, part, n, turns): dialogues as ordered parts of bounded size.

    `turns` are (at, turn, role, text) structs in order, `n` the turns of the whole dialogue.
    Parts in order are the dialogue; `last_part` says which one ends it.
    """
    whole = F.struct("at", "turn", "role", "text")
    return placed(turns, chars).groupBy("conv_id", "part").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(whole)).alias("turns"))


def last_part() -> Column:
    return F.element_at("turns", -1)["at"] == F.col("n") - 1


def part_lines(head: str, tail: str) -> Column:
    """A part's lines `A: ..` and `B: ..` by place in the dialogue, with what opens and ends it.

    The lines of all parts in order are what rendering the dialogue as one value gives.
    """
    lines = F.array_join(F.transform("turns", lambda u: F.concat(speaker(u["at"]), F.lit(": "), u["text"], F.lit("\n"))), "")
    first = F.get("turns", 0)["at"] == 0
    return F.concat(F.when(first, F.lit(head)).otherwise(""), lines, F.when(last_part(), F.lit(tail)).otherwise(""))


def drop_long_turns(dialogue: DataFrame, limit: int) -> DataFrame:
    """Drop empty or long turns; a dialogue stays if two turns remain."""
    kept = F.filter("turns", lambda u: (F.length(u["text"]) > 0) & (F.length(u["text"]) <= limit))
    return dialogue.withColumn("turns", kept).where(F.size("turns") >= 2)


def two_speakers(dialogue: DataFrame, limit: int) -> DataFrame:
    """Whole dialogues of two strictly alternating speakers without empty or long turns."""
    roles, texts = F.col("turns.role"), F.col("turns.text")
    n = F.size("turns")
    return dialogue.where(
        (n >= 2) & (F.size(F.array_distinct(roles)) == 2)
        & F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                   lambda i: F.get(roles, i) != F.get(roles, i - 1))
        & F.forall(texts, lambda x: F.length(x).between(1, limit)))
