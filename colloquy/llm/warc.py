"""WARC archives: one gzip member per record, written and read in tasks.

Writing: every task writes its rows as archives of bounded size into the shared folder and
returns their paths; only returned paths are read, so what a lost attempt leaves behind
counts for nothing. A payload that several pages share is written once, with the page of the
greatest id, and the others revisit it: their records hold the HTTP head alone.

Reading: the members of an archive are decompressed one after the other in small blocks, each
record is framed by its content length, and block and payload digests are verified. No more
than one record is in memory. A record that breaks off or fails a digest comes with `problem`
filled in, and reading goes on at the next member; where a member cannot be unpacked, at the next
place where one may start. Damage that follows on damage is reported once.

Defined cases: a null page is an empty payload and a null URL an empty one; a page without an
id is always a response and nothing refers to it; rows that repeat an id and a payload are
all responses or all revisits; equal payloads under one id are responses; of equal payloads the
greatest id is the response, so there are no ties; an empty table gives no archive and no rows;
payloads of any length are one record, held whole by one task at a time; further columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.joins import small_or_not, spread_join
from colloquy.session import scratch_path

from .common import store

ARCHIVE_BYTES = 64 << 20  # an archive is closed once it is this large
LEVEL = 1
READ_BYTES = 64 << 10
HEAD_BYTES = 1 << 20      # no record head is longer
END = b"\r\n\r\n"
START = b"\x1f\x8b\x08"

RECORD_SCHEMA = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
                 "payload_digest string, payload binary, problem string")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    name = f"urn:page:{page_id}" if page_id is not None else uuid.uuid5(uuid.NAMESPACE_URL, url + digest(payload)).urn
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", clean)]
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("WARC-Payload-Digest", "sha1:" + digest(payload)), ("WARC-Block-Digest", "sha1:" + digest(block)),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return member.compress(lines.encode() + block + END) + member.flush()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_fs, root = fs.FileSystem.from_uri(folder)
        out, path, count, size = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, html, refers in zip(*batch.columns):
                if out is None:
                    path, count, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store_fs.open_output_stream(path, compression=None)
                html = html.as_py()
                data = record(page_id.as_py(), url.as_py() or "", b"" if html is None else html.encode(), refers.as_py())
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()),
                                          pa.array([n for _, n in done], pa.int64())], ["path", "records"])
    return write


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, sha, refers_to of the pages whose payload a page of a greater id holds too."""
    rows = store(pages.select("page_id", _sha().alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
                 .where("page_id IS NOT NULL"), "warc-digests")
    most = rows.groupBy("sha", "n").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
    # One payload may be that of a third of all pages.
    shared = spread_join(rows, most.where("least < refers_to"), ["sha", "n"], F.col("page_id"), "inner")
    return shared.where("page_id < refers_to").select("page_id", "sha", "refers_to").distinct()


def _sha():
    return F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """path, records of the archives written for `pages` (page_id, url, html)."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "llm-warc")
    target, root = fs.FileSystem.from_uri(folder)
    target.create_dir(root, recursive=True)
    pages = pages.select("page_id", "url", "html")
    # Two numbers and a digest per revisit; beyond the checked size the join is shuffled.
    known = small_or_not(store(revisits(pages), "warc-revisits"))
    rows = pages.withColumn("sha", _sha()).join(known, ["page_id", "sha"], "left")
    return store(rows.select("page_id", "url", "html", "refers_to").mapInArrow(
        _writer(folder), "path string, records long"), "warc-manifest")


class Members:
    """The gzip members of a stream, each as an iterator of decompressed pieces."""

    def __init__(self, stream):
        self.stream, self.rest, self.raw = stream, b"", bytearray()

    def more(self) -> bool:
        if not self.rest:
            self.rest = self.stream.read(READ_BYTES)
        return bool(self.rest)

    def pieces(self) -> Iterator[bytes]:
        unpack, self.raw = zlib.decompressobj(31), bytearray()
        while not unpack.eof:
            if not self.more():
                raise EOFError("archive ends inside a record")
            data, self.rest = self.rest, b""
            self.raw += data
            piece = unpack.decompress(data, READ_BYTES * 4)
            self.rest = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            del self.raw[len(self.raw) - len(self.rest):]
            yield piece

    def find_next(self) -> None:
        """Leave a member that cannot be unpacked, for the next place that looks like a start. A
        member that lost bytes may have run into the one after it, so its own bytes are searched."""
        held, start = bytes(self.raw) + self.rest, 1
        self.raw = bytearray()
        while (at := held.find(START, start)) < 0:
            more = self.stream.read(READ_BYTES)
            if not more:
                self.rest = b""
                return
            held, start = held[max(start, len(held) - len(START) + 1):] + more, 0
        self.rest = held[at:]


def _fields(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _page(name: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name)
    return int(m[1]) if m else None


def read_record(pieces: Iterator[bytes], with_payload: bool) -> tuple:
    """The record in one member, framed by its content length."""
    data = bytearray()
    while (cut := data.find(END)) < 0:
        data += next(pieces)
        if len(data) > HEAD_BYTES and data.find(END) < 0:
            raise ValueError("no end of the record's head")
    head, block = _fields(bytes(data[:cut])), data[cut + 4:]
    length = int(head["content-length"])
    for piece in pieces:
        block += piece
        if len(block) > length + len(END):
            raise ValueError("record is longer than its content length")
    problem = None
    if bytes(block[length:]) != END:
        problem = "record does not end where its content length says"
    block = bytes(block[:length])
    if "sha1:" + digest(block) != head.get("warc-block-digest"):
        problem = "block digest differs"
    http, _, payload = block.partition(END)
    kind, payload_digest = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:")
    size = int(_fields(http).get("content-length", "0"))
    if kind == "response" and (digest(payload) != payload_digest or len(payload) != size):
        problem = problem or "payload digest differs"
    return (_page(head["warc-record-id"]), head.get("warc-target-uri"), kind,
            _page(head.get("warc-refers-to", "")), size, payload_digest,
            payload if with_payload and kind == "response" else None, problem)


def next_record(members: Members, with_payload: bool) -> tuple[tuple, bool]:
    """The next record or what is wrong with it, and whether a place to go on had to be found."""
    pieces = members.pieces()
    try:
        return read_record(pieces, with_payload), False
    except (zlib.error, EOFError, StopIteration, KeyError, ValueError) as e:
        found = (None,) * 7 + (f"{type(e).__name__}: {e}",)
        unpacked = not isinstance(e, (zlib.error, EOFError))
    try:
        for _ in pieces if unpacked else ():
            pass
    except (zlib.error, EOFError):
        unpacked = False
    if not unpacked:
        members.find_next()
    return found, not unpacked


def _reader(folder_uri: str, with_payload: bool):
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, _ = fs.FileSystem.from_uri(folder_uri)
        for batch in batches:
            for path in batch.column(0):
                with source.open_input_stream(path.as_py(), compression=None) as stream:
                    members, rows, held, lost = Members(stream), [], 0, False
                    while members.more():
                        found, again = next_record(members, with_payload)
                        if not (lost and again):
                            rows.append(found)
                            held += len(found[6] or b"") + 200
                        lost = again
                        if held > 4 << 20:
                            yield out(rows)
                            rows, held = [], 0
                    if rows:
                        yield out(rows)
    return read


def read_archives(manifest: DataFrame, with_payload: bool = True, folder: str | None = None) -> DataFrame:
    """The records of the archives at `path`, one archive per task at a time."""
    spark = manifest.sparkSession
    uri = folder or scratch_path(spark, "llm-warc")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts, "path").mapInArrow(_reader(uri, with_payload), RECORD_SCHEMA)
