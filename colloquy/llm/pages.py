"""Text of web pages, laid out as it is seen.

Spark hands out pages; one page is one small tree in a task (see `layout`), so memory is
bounded by the largest page.

Defined cases: a null page has null title and empty text, an empty one too; markup that does
not end is text up to the end; elements nested deeper than a fixed depth are not opened but
their text stays; repeated rows have equal results; an empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .layout import page_text

BATCH_BYTES = 4 << 20


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(ids: list, found: list[tuple[str | None, str]]) -> pa.RecordBatch:
        titles, texts = zip(*found)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(titles, pa.string()), pa.array(texts, pa.string()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([t.count("\n\n") + 1 if t else 0 for t in texts], pa.int64())],
            ["page_id", "title", "text", "n_chars", "n_blocks"])
    for batch in batches:
        ids, found, size = [], [], 0
        for page_id, page in zip(batch.column(0), batch.column(1)):
            ids.append(page_id.as_py())
            found.append(page_text(page.as_py() or ""))
            size += len(found[-1][1])
            if size > BATCH_BYTES:
                yield out(ids, found)
                ids, found, size = [], [], 0
        if ids:
            yield out(ids, found)


def visible_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, title, text, n_chars, n_blocks for every row."""
    return pages.select(id_col, html_col).mapInArrow(
        _text_batches, "page_id long, title string, text string, n_chars long, n_blocks long")
