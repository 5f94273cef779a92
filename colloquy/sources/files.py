"""Readers for chat XML, source trees and NUL-joined blobs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import clean_chat_post

POSTS = "_class string, _pos bigint, _VALUE string"


def read_chat_xml(spark: SparkSession, path: str, session: Column | None = None) -> DataFrame:
    """(session, pos, act, text), text cleaned, act `Other` by default.

    A file is a session unless `session` names another column, such as a folder of a
    partitioned layout. XML rows carry no order, so posts must have a `pos` attribute.
    """
    rows = (spark.read.format("xml").option("rowTag", "Post").option("mode", "PERMISSIVE")
            .schema(POSTS).load(path).withColumn("_file", F.col("_metadata.file_name")))
    return rows.select(
        (F.regexp_replace("_file", r"\.xml$", "") if session is None else session).alias("session"),
        F.col("_pos").alias("pos"),
        F.coalesce("_class", F.lit("Other")).alias("act"),
        clean_chat_post(F.col("_VALUE")).alias("text"))


def extension(path: Column) -> Column:
    """Lower-case extension without its dot, '' if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def decoded(content: Column) -> Column:
    """The text of UTF-8 bytes, without those that are not."""
    raw = content.cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan_source_files(spark: SparkSession, root: str, subdirs: list[str] | None = None,
                      skip_dirs: list[str] = V.SKIP_DIRS, exts: list[str] | None = None,
                      max_bytes: int = V.MAX_FILE_BYTES) -> DataFrame:
    """(path, ext, n_bytes, text, valid) of source files under `root`, paths relative to it.

    Names and sizes are tested before any content is read: `length` is pushed to the
    file listing. Bytes that are not UTF-8 are left out of the text, and `valid` is false.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .where(F.col("length") <= max_bytes))
    # Listed paths are the root's own path, behind a scheme it may not have named, and the rest.
    top = re.sub(r"^[a-zA-Z][\w+.-]*:/*", "/", root).rstrip("/") + "/"
    inner = F.expr(f"substr(path, instr(path, {quoted(top)}) + {len(top)})")
    folders = F.split(F.regexp_replace(inner, "/?[^/]*$", ""), "/")
    keep = ~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in skip_dirs]))
    keep = keep & extension(inner).isin([e.lower() for e in exts or V.EXT_LANGUAGE])
    if subdirs:  # start folders may be nested
        starts = [F.startswith(inner, F.lit(d.strip("/") + "/")) for d in subdirs]
        keep = keep & reduce(lambda a, b: a | b, starts)
    return files.where(keep).select(
        inner.alias("path"), extension(inner).alias("ext"), F.col("length").alias("n_bytes"),
        decoded(F.col("content")).alias("text"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"))


def read_nul_blob(spark: SparkSession, path: str) -> DataFrame:
    """(path, ext, lang, text) of a blob of `path\\nsource` chunks joined by NUL.

    Empty chunks are dropped; a chunk whose extension names no language keeps a null lang.
    """
    chunks = spark.read.option("lineSep", "\0").text(path).where(~F.col("value").rlike(r"^\s*$"))
    name = F.substring_index("value", "\n", 1)
    rows = chunks.select(name.alias("path"), extension(name).alias("ext"),
                         F.substring(F.col("value"), F.length(name) + 2, F.length("value")).alias("text"))
    languages = F.create_map(*[F.lit(x) for kv in V.EXT_LANGUAGE.items() for x in kv])
    return rows.withColumn("lang", F.try_element_at(languages, F.col("ext")))
