"""Worked problems: several source shapes to one, then the filters all of them share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import fixed_values as V
from ..functions import predicates as P
from ..functions import text as T
from ..functions.hashing import held_out
from ..functions.once import keep_computed

@dataclass
class Rendering:
    """What a row says, as columns. Rows that do not pass `keep` are dropped."""

    question: Column
    think: Column
    answer: Column
    identity: Column | None = None  # of the problem, for splitting; the question by default
    keep: Column | None = None

    def struct(self) -> Column:
        identity = self.question if self.identity is None else self.identity
        made = F.struct(self.question.alias("question"), self.think.alias("think"),
                        self.answer.alias("answer"), identity.alias("identity"))
        return made if self.keep is None else F.when(self.keep, made)


Renderer = Callable[[], Rendering]
RENDERERS: dict[str, Renderer] = {}
FIELDS = ["question", "think", "answer", "identity"]


def renderer(kind: str):
    """Register how rows of one kind are read."""
    def register(fn: Renderer) -> Renderer:
        RENDERERS[kind] = fn
        return fn
    return register


def render(rows: DataFrame, made: Column) -> DataFrame:
    """Rows with the fields of a rendering in place of their own; null drops a row."""
    out = rows.withColumn("_r", F.explode(F.filter(F.array(made), lambda r: r.isNotNull())))
    kept = [c for c in rows.columns if c in ("doc_id", "source", "kind")]
    return out.select(*kept, *[F.col(f"_r.{f}").alias(f) for f in FIELDS])


@renderer("hash_marks")
def hash_marks() -> Rendering:
    """Solutions of one step per line that end in `#### value`."""
    return Rendering(
        F.col("question"), T.strip_calc_notes(F.substring_index("solution", "####", 1)),
        F.regexp_extract("solution", r"(?s)####(.*)$", 1), keep=F.contains("solution", F.lit("####")))


def qa(question: str, solution: str) -> Renderer:
    """A question and a worked solution whose answer is found in the text."""
    def read() -> Rendering:
        pair = X.split_answer(F.col(solution))
        return Rendering(F.col(question), pair["steps"], pair["answer"])
    return read


RENDERERS["qa"] = qa("question", "solution")


@renderer("rephrased")
def rephrased() -> Rendering:
    """Many phrasings of one problem share the identity of the original question."""
    own = F.coalesce(F.nullif(F.col("original_question"), F.lit("")), F.col("question"))
    return replace(RENDERERS["qa"](), identity=own)


@renderer("cot_only")
def cot_only() -> Rendering:
    """Only rows that reason in prose; the others answer by writing code."""
    return replace(RENDERERS["qa"](), keep=F.contains(F.coalesce("origin", F.lit("")), F.lit("/CoT/")))


@renderer("options")
def options() -> Rendering:
    """Choices go into the question; the answer is the gold letter."""
    asked = T.strip(F.coalesce("question", F.lit("")))
    asked = F.when(F.size("choices") > 0, F.concat(
        asked, F.lit("\nOptions: "), F.array_join("choices", " "))).otherwise(asked)
    why = T.strip(F.coalesce("solution", F.lit("")))
    closes = X.has_mark(why) | X.last_boxed(why).isNotNull()
    return Rendering(asked, F.when(closes, X.split_answer(why)["steps"]).otherwise(why), F.col("gold"))


@renderer("expected_answer")
def expected_answer() -> Rendering:
    """The answer has its own field; solutions with code are left to another corpus."""
    return Rendering(F.col("question"), F.col("solution"), F.col("gold"),
                     keep=~P.has_code(F.col("solution")))


@renderer("yes_no")
def yes_no() -> Rendering:
    return Rendering(F.col("question"), F.col("solution"), F.when(F.col("truth"), "yes").otherwise("no"),
                     keep=F.col("truth").isNotNull())


# The test table has 20 sources; which shape a source has is fixed by its number.
KINDS = ["hash_marks", "qa", "rephrased", "cot_only", "options", "expected_answer", "yes_no"]
KIND_SQL = ("CASE substr(source, 4)::INTEGER % 7 "
            + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END")


def raw_sources(recut: DataFrame) -> DataFrame:
    """Question/steps/answer rows dressed as the source shapes the renderers read."""
    i = F.col("doc_id")
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), F.substring("source", 4, 9).cast("int") % 7)
    rows = recut.withColumn("kind", kind)
    solution = (
        F.when(F.col("kind") == "hash_marks", F.concat(
            F.col("steps"), F.lit(" <<1+1=2>> #### "), i.cast("string")))
        .when((F.col("kind") == "expected_answer") & (i % 10 == 0),
              F.concat(F.col("steps"), F.lit("\n```python\n1\n```")))
        .when(F.col("kind").isin("options", "yes_no", "expected_answer"), F.col("steps"))
        .otherwise(F.concat_ws("\n", "steps", "answer")))
    return rows.select(
        "doc_id", "source", "kind", "question", solution.alias("solution"),
        F.when(F.col("kind") == "options", F.lit("B")).otherwise(F.col("answer")).alias("gold"),
        F.array(F.concat(F.lit("A)"), i.cast("string")),
                F.concat(F.lit("B)"), (i + 1).cast("string"))).alias("choices"),
        F.concat(F.lit("P"), F.floor(i / 3).cast("string")).alias("original_question"),
        F.when(i % 2 == 0, "data/PoT/x").otherwise("data/CoT/x").alias("origin"),
        (i % 2 == 0).alias("truth"))


def render_all(raw: DataFrame) -> DataFrame:
    """Rows of all kinds rendered in one pass; a row is read only as its own kind."""
    kinds = iter(RENDERERS.items())
    kind, read = next(kinds)
    made = F.when(F.col("kind") == kind, read().struct())
    for kind, read in kinds:
        made = made.when(F.col("kind") == kind, read().struct())
    return render(raw, made)


def clean_traces(rendered: DataFrame) -> DataFrame:
    """The cleaning and limits every source shares; adds the held-out side."""
    rows = keep_computed(rendered, {
        "question": T.normalize_ws(F.col("question")),
        "think": T.squeeze_blank_lines(X.strip_trailing_markers(T.clean_steps(F.col("think")))),
        "answer": X.tighten_answer(T.normalize_ws(F.col("answer")))},
        lambda r: P.trace_ok(r["question"], r["think"], r["answer"]))
    identity = F.coalesce(F.nullif(F.col("identity"), F.lit("")), F.col("question"))
    return rows.withColumn("identity", T.identity_key(identity)).withColumn(
        "held_out", held_out(F.col("identity"), V.REASON_HOLDOUT))
