"""A training corpus from raw documents, one written stage after the other.

Every stage works on all rows its predecessor kept and, but for the last, returns the columns
of `documents`. Rejected documents and near copies are gone, documents with benchmark
passages too; the mix repeats documents of sources that weigh more than their share and
leaves some of the others out; the last stage places what is left into shards.

Defined results, for every stage. Null and empty texts have no words, so quality rules reject
them; a row without a doc_id is judged like any other, is never a near copy to be dropped, and
keeps its place in mix and shards. Texts of any length are taken whole. Rows that repeat an id
and a text are one document to near-duplicate removal, and rows of their own to every other
stage. Ties go to the smallest doc_id among near copies, and to the order of the operators'
docstrings elsewhere. An empty table passes every stage as an empty table. Of the input only the
columns of `documents` are read, whatever others are named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, mixing, neardup, quality, sharding
from colloquy.llm.common import inner_tables, store, table
from colloquy.operators.joins import small_or_not

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others keep the lines that passed."""
    kept = quality.judge_lines(docs.select(*COLUMNS)).where("kept")
    return kept.select("doc_id", F.col("cleaned_text").alias("text"), "lang", "source",
                       F.length("cleaned_text").cast("bigint").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; rows that repeat an id and a text
    are one document."""
    with inner_tables(spark):
        judged = neardup.near_duplicates(docs).where("NOT kept AND doc_id IS NOT NULL")
        gone = store(judged.select("doc_id").distinct(), "pipe-gone", keep=True)
    # One number per row. Beyond the checked size the join is shuffled.
    return docs.join(small_or_not(gone), "doc_id", "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go."""
    judged = decontaminate.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return judged.where("NOT contaminated").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, repeated or left out."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontaminated),
          ("source_mix", source_mix), ("sharding", shards)]

# Components of near copies and the search for the shard capacity are not expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
