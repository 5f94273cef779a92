"""Token streams as a Spark data source: 16-bit ids, a mask beside them, and an offset index.

    docs.write.format("token_shards").mode("overwrite").save(path)     # key, split, ids[, mask]
    spark.read.format("token_shards").option("split", "train").load(path)
    spark.read.format("token_shards").option("crop", 65).option("draws", 2).load(path)

Each task appends the ids of its rows to one flat file per split (little-endian, two bytes an
id), the mask to another (a byte an id), and writes an index of (key, offset, n). What has been
written is told to the driver as one short message per task. `commit` names those files in a
manifest, which is put in place in one move; a reader knows only what a manifest names. So a task
that failed or ran twice, and a job that died, leave nothing that can be read. `abort` removes
the files of the tasks that had finished; what killed tasks leave behind goes with `sweep`, once no
job is writing there.

A reader plans one partition per row group of the index. Whole documents of a partition are one
range of the files. A crop reads its own range only: where it starts is a hash of the key, so the
bytes read are those of the crops, and a retry draws the same.

Paths are those of a file system that `pyarrow` can name (a mounted folder, s3, gs, hdfs).
Defined results: null ids count as none, a null mask supervises every id, a null key or split
reads as the empty string. An id outside 0..65535 or a mask of another length than its ids fails
the write.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "token_shards"
MANIFEST = "_manifest.json"
GROUP = 4096  # documents of an index row group, and of a partition
WHOLE = "key string, split string, ids array<int>, mask array<tinyint>"
CROPS = "key string, split string, k bigint, start bigint, ids array<int>, mask array<tinyint>"
INDEX = pa.schema([("key", pa.string()), ("offset", pa.int64()), ("n", pa.int64())])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path.rstrip("/")
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    system, inner = pafs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def manifest_of(path: str) -> dict[str, Any] | None:
    system, folder = opened(path)
    name = f"{folder}/{MANIFEST}"
    if system.get_file_info(name).type == pafs.FileType.NotFound:
        return None
    with system.open_input_stream(name) as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict[str, Any]]


class Part:
    """One split's files of one task."""

    def __init__(self, system: pafs.FileSystem, folder: str, split: str):
        self.split, self.name = split, uuid.uuid4().hex
        base = f"{folder}/{self.name}"
        self.ids = system.open_output_stream(f"{base}.ids")
        self.mask = system.open_output_stream(f"{base}.mask")
        self.out = system.open_output_stream(f"{base}.index")
        self.index = pq.ParquetWriter(self.out, INDEX)
        self.held: list[pa.RecordBatch] = []
        self.docs = self.tokens = self.supervised = 0

    def add(self, keys: pa.Array, sizes: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> None:
        ends = self.tokens + np.cumsum(sizes)
        self.ids.write(ids.astype("<u2").tobytes())
        self.mask.write(mask.astype(np.uint8).tobytes())
        self.held.append(pa.record_batch([keys, pa.array(ends - sizes), pa.array(sizes)], schema=INDEX))
        self.docs += len(sizes)
        self.tokens += int(sizes.sum())
        self.supervised += int(mask.sum())
        if sum(len(b) for b in self.held) >= 16 * GROUP:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.index.write_table(pa.Table.from_batches(self.held), row_group_size=GROUP)
            self.held = []

    def close(self) -> dict[str, Any]:
        self.flush()
        for f in (self.index, self.out, self.ids, self.mask):
            f.close()
        return {"name": self.name, "split": self.split, "docs": self.docs, "tokens": self.tokens, "supervised": self.supervised}


def list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values of a column of lists; null lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    if values.null_count:
        raise ValueError("null among ids or mask values")
    return sizes, values.to_numpy(zero_copy_only=False)


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = opened(self.path)
        system.create_dir(f"{folder}/parts", recursive=True)
        parts: dict[str, Part] = {}
        try:
            for batch in iterator:
                self._add(batch, parts, system, f"{folder}/parts")
            return Written([p.close() for p in parts.values()])
        except BaseException:
            remove(system, f"{folder}/parts", [p.name for p in parts.values()])
            raise

    def _add(self, batch: pa.RecordBatch, parts: dict[str, Part], system: pafs.FileSystem, folder: str) -> None:
        names = batch.schema.names
        text = [pc.fill_null(batch.column(n).cast(pa.string()), "") if n in names else pa.array([""] * len(batch))
                for n in ("key", "split")]
        sizes, ids = list_values(batch.column("ids"))
        if len(ids) and (ids.min() < 0 or ids.max() > 65535):
            raise ValueError("an id does not fit 16 bits")
        mask = np.ones(len(ids), np.uint8)
        ends = np.cumsum(sizes)
        if "mask" in names:
            column = batch.column("mask")
            kept = column.is_valid().to_numpy(zero_copy_only=False)
            given, values = list_values(column)
            if (given[kept] != sizes[kept]).any():
                raise ValueError("a mask has another length than its ids")
            mask[np.repeat(kept, sizes)] = values
        splits = text[1].to_numpy(zero_copy_only=False)
        for split in dict.fromkeys(splits):
            rows = splits == split
            if split not in parts:
                parts[split] = Part(system, folder, split)
            tokens = np.repeat(rows, sizes)
            parts[split].add(text[0].filter(pa.array(rows)), sizes[rows], ids[tokens], mask[tokens])
        assert len(ends) == 0 or ends[-1] == len(ids)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        old = manifest_of(self.path) or {"parts": []}
        new = [p for m in messages if m is not None for p in m.parts]
        system.create_dir(folder, recursive=True)
        temporary = f"{folder}/{MANIFEST}.{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as f:
            f.write(json.dumps({"parts": new if self.overwrite else old["parts"] + new}).encode())
        system.move(temporary, f"{folder}/{MANIFEST}")
        if self.overwrite:
            remove(system, f"{folder}/parts", [p["name"] for p in old["parts"]])

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        remove(system, f"{folder}/parts", [p["name"] for m in messages if m is not None for p in m.parts])


def remove(system: pafs.FileSystem, folder: str, names: list[str]) -> None:
    for name in names:
        for kind in ("ids", "mask", "index"):
            if system.get_file_info(f"{folder}/{name}.{kind}").type != pafs.FileType.NotFound:
                system.delete_file(f"{folder}/{name}.{kind}")


NOTE = "_complete"


def write_note(path: str, text: str) -> None:
    """Mark what has been written at `path` as complete, with a note on it."""
    system, folder = opened(path)
    temporary = f"{folder}/{NOTE}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as f:
        f.write(text.encode())
    system.move(temporary, f"{folder}/{NOTE}")


def read_note(path: str) -> str | None:
    system, folder = opened(path)
    if system.get_file_info(f"{folder}/{NOTE}").type == pafs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{folder}/{NOTE}") as f:
        return f.read().decode()


def sweep(path: str) -> int:
    """Remove the files that no manifest names; how many there were."""
    system, folder = opened(path)
    known = {p["name"] for p in (manifest_of(path) or {"parts": []})["parts"]}
    found = system.get_file_info(pafs.FileSelector(f"{folder}/parts", allow_not_found=True))
    lost = [f.path for f in found if f.is_file and f.base_name.split(".")[0] not in known]
    for name in lost:
        system.delete_file(name)
    return len(lost)


class Group(InputPartition):
    def __init__(self, name: str, split: str, group: int):
        super().__init__((name, split, group))


def drawn(salt: str, key: str, k: int) -> int:
    """The number that `functions.hashing.u32` draws for `key-k`."""
    return int(hashlib.md5(f"{salt}:{key}-{k}".encode()).hexdigest()[:8], 16)


class ShardReader(DataSourceReader):
    def __init__(self, path: str, split: str | None, crop: int, draws: int, salt: str):
        self.path, self.split, self.crop, self.draws, self.salt = path, split, crop, draws, salt

    def partitions(self) -> list[Group]:
        found = manifest_of(self.path)
        if found is None:
            raise FileNotFoundError(f"nothing has been committed at {self.path}")
        return [Group(p["name"], p["split"], g) for p in found["parts"] if self.split in (None, p["split"])
                for g in range(-(-p["docs"] // GROUP))] or [Group("", "", -1)]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        name, split, group = partition.value
        if group < 0:
            return
        system, folder = opened(self.path)
        base = f"{folder}/parts/{name}"
        with system.open_input_file(f"{base}.index") as f:
            index = pq.ParquetFile(f).read_row_group(group)
        with system.open_input_file(f"{base}.ids") as ids, system.open_input_file(f"{base}.mask") as mask:
            yield from self._crops(index, split, ids, mask) if self.crop else self._whole(index, split, ids, mask)

    def _whole(self, index: pa.Table, split: str, ids: pa.NativeFile, mask: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(index), 256):
            some = index.slice(at, 256)
            start, size = some["offset"][0].as_py(), pc.sum(some["n"]).as_py()
            offsets = np.concatenate([[0], np.cumsum(some["n"].to_numpy())]).astype(np.int32)
            yield self._batch([some["key"].combine_chunks(), pa.array([split] * len(some))], offsets, *ranges(ids, mask, [(start, size)]))

    def _crops(self, index: pa.Table, split: str, ids: pa.NativeFile, mask: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        """Ranges of `crop` ids of documents that have more, `draws` of each."""
        found = [(key, k, drawn(self.salt, key, k) % (n - self.crop + 1), offset)
                 for key, offset, n in zip(*[index[c].to_pylist() for c in ("key", "offset", "n")])
                 if n > self.crop for k in range(self.draws)]
        for at in range(0, len(found), 1024):
            some = found[at:at + 1024]
            values = ranges(ids, mask, [(offset + start, self.crop) for _, _, start, offset in some])
            offsets = np.arange(len(some) + 1, dtype=np.int32) * self.crop
            lead = [pa.array([x[0] for x in some]), pa.array([split] * len(some)), pa.array([x[1] for x in some], pa.int64()),
                    pa.array([x[2] for x in some], pa.int64())]
            yield self._batch(lead, offsets, *values)

    def _batch(self, lead: list[pa.Array], offsets: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in (ids.astype(np.int32), mask.astype(np.int8))]
        names = ["key", "split", "k", "start", "ids", "mask"] if self.crop else ["key", "split", "ids", "mask"]
        return pa.RecordBatch.from_arrays([*lead, *lists], names=names)


def ranges(ids: pa.NativeFile, mask: pa.NativeFile, wanted: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The given ranges (start, size) of both files, one after the other."""
    a, b = [], []
    for start, size in wanted:
        ids.seek(2 * start)
        mask.seek(start)
        a.append(ids.read(2 * size))
        b.append(mask.read(size))
    return np.frombuffer(b"".join(a), "<u2"), np.frombuffer(b"".join(b), np.uint8)


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CROPS if "crop" in self.options else WHOLE

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], overwrite)

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(self.options["path"], self.options.get("split"), int(self.options.get("crop", 0)),
                           int(self.options.get("draws", 1)), self.options.get("salt", "crop"))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(TokenShards)
    return spark


def written_counts(path: str) -> list[tuple[str, int, int, int]]:
    """(split, docs, tokens, supervised) as the committed tasks counted them."""
    sums: dict[str, list[int]] = {}
    for p in (manifest_of(path) or {"parts": []})["parts"]:
        row = sums.setdefault(p["split"], [0, 0, 0])
        for i, name in enumerate(("docs", "tokens", "supervised")):
            row[i] += p[name]
    return [(split, *row) for split, row in sorted(sums.items())]
