"""WARC archives written and read through a chunked record table.

A payload travels as rows ``(record, chunk number, bytes)`` of ``chunk_bytes``
at most: the writer compresses chunk after chunk into the record's gzip
member, the reader parses a file as a stream and emits chunk rows that carry
the digest of the payload up to their end.  Neither holds a whole record; the only
place that does is the input's cell, from which the plan cuts the chunks.

Records with equal payloads of at least ``min_revisit`` bytes are written
once, as the response of the smallest id; the others are ``revisit`` records.
Only ids and digests are shuffled to find them, combined before the shuffle,
and only digests that occur twice are joined back.

Every writing task opens files of its own, named after its attempt, and
returns one row a file; that manifest is written as a table, so a file of a
lost or repeated attempt is not in it and is never read.

Defined results: a NULL payload counts as empty; a NULL id is larger than any
other; rows that repeat id and payload are the same record, written as often
as they occur.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoframe.llm.common import quoted, written
from spoframe.session import fresh_path

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK_BYTES = 1 << 20
ROLL_BYTES = 1 << 30

MANIFEST = "path string, records long, bytes long"
CHUNKS = (
    "record_id string, page_id long, target_uri string, record_type string, refers_to long, chunk_no long, "
    "data binary, chunk_end long, digest_so_far string, last boolean, payload_bytes long, payload_digest string"
)


def plan_records(
    pages: DataFrame,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    min_revisit: int = 100,
) -> DataFrame:
    """One row a record: ids, type, digest and the payload itself (``payload`` binary)."""
    payload = F.coalesce(F.col(quoted(payload_col)).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(
        F.col(quoted(id_col)).cast("long").alias("page_id"),
        F.col(quoted(uri_col)).cast("string").alias("target_uri"),
        payload.alias("payload"),
    ).withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.length("payload").cast("long")})
    repeated = written(
        rows.filter(F.col("payload_bytes") >= min_revisit)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n"),
        "warc-repeated",
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    record_id = lambda page: F.concat(F.lit("urn:sha1:"), F.sha1(F.concat_ws("/", page, "payload_digest")))
    return rows.join(repeated, "payload_digest", "left").select(
        record_id(F.col("page_id")).alias("record_id"),
        "page_id",
        "target_uri",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
        F.when(revisit, record_id(F.col("first_id"))).alias("refers_to_record"),
        "payload_digest",
        "payload_bytes",
        F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload")).alias("payload"),
    )


def chunk_table(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The planned records as chunk rows: ``payload`` becomes ``chunk_no`` and ``data``."""
    last = F.greatest(F.floor((F.length("payload") - 1) / chunk_bytes), F.lit(0))
    rows = records.select(*records.columns, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_no"))
    start = (F.col("chunk_no") * chunk_bytes + 1).cast("int")
    return rows.withColumn("data", F.substring("payload", start, F.lit(chunk_bytes))).drop("payload")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _head(r: dict) -> bytes:
    """Header of a record, and the HTTP header that its block begins with."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n"
    revisit = r["record_type"] == "revisit"
    lines = [
        f"WARC-Type: {r['record_type']}",
        f"WARC-Record-ID: <{r['record_id']}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{r['payload_digest']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else r['payload_bytes'])}",
    ]
    if r["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_one_line(r['target_uri'])}")
    if r["page_id"] is not None:
        lines.append(f"X-Page-ID: {r['page_id']}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{r['refers_to_record']}>", f"X-Refers-To-Page-ID: {r['refers_to']}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + http.encode()


class _Writer:
    """Files of one task attempt."""

    def __init__(self, folder: str, roll_bytes: int):
        self.system, base = _place(folder)
        task = TaskContext.get()
        self.base = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        self.folder, self.roll_bytes = folder, roll_bytes
        self.system.create_dir(base, recursive=True)
        self.files: list[tuple[str, int, int]] = []
        self.out = None
        self.member = None

    def _begin_file(self) -> None:
        name = f"{self.base}-{len(self.files):04d}.warc.gz"
        self.out, self.records = self.system.open_output_stream(name, compression=None), 0
        self.name = f"{self.folder}/{name.rsplit('/', 1)[1]}"

    def end_file(self) -> None:
        if self.out is not None:
            size = self.out.tell()
            self.out.close()
            self.files.append((self.name, self.records, size))
            self.out = None

    def end_record(self) -> None:
        if self.member is None:
            return
        self.out.write(self.member.compress(b"\r\n\r\n") + self.member.flush())
        self.member = None
        self.records += 1
        if self.out.tell() >= self.roll_bytes:
            self.end_file()

    def chunk(self, r: dict) -> None:
        if r["chunk_no"] == 0:
            self.end_record()
            if self.out is None:
                self._begin_file()
            self.member = zlib.compressobj(1, zlib.DEFLATED, 31)
            self.out.write(self.member.compress(_head(r)))
        self.out.write(self.member.compress(r["data"]))


def write_warc(chunks: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write chunk rows as ``.warc.gz`` files; returns the written manifest.

    The chunks of a record must follow each other in one partition, as
    :func:`chunk_table` leaves them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, roll_bytes)
        for rows in batches:
            for at in range(0, rows.num_rows, 64):
                for r in rows.slice(at, 64).to_pylist():
                    writer.chunk(r)
        writer.end_record()
        writer.end_file()
        names, records, sizes = zip(*writer.files, strict=True) if writer.files else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())],
            ["path", "records", "bytes"],
        )

    return written(chunks.mapInArrow(run, MANIFEST), "warc-manifest")


def _headers(stream) -> dict[str, str]:
    found = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _long(value: str | None) -> int | None:
    return None if value is None else int(value)


def read_records(stream: io.BufferedIOBase, chunk_bytes: int, with_data: bool) -> Iterator[dict]:
    """Chunk rows of the records in an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        h = _headers(stream)
        left = int(h["content-length"])
        payload_bytes = left
        if h.get("content-type", "").startswith("application/http"):
            before = stream.tell()
            stream.readline()
            payload_bytes = int(_headers(stream).get("content-length", 0))
            left -= stream.tell() - before
        row = {
            "record_id": h["warc-record-id"].strip("<>"),
            "page_id": _long(h.get("x-page-id")),
            "target_uri": h.get("warc-target-uri"),
            "record_type": h["warc-type"],
            "refers_to": _long(h.get("x-refers-to-page-id")),
            "payload_bytes": payload_bytes,
        }
        digest, number, end = hashlib.sha256(), 0, 0
        while True:
            data = stream.read(min(left, chunk_bytes)) if left else b""
            if left and not data:
                raise ValueError(f"record {row['record_id']} is cut off")
            left -= len(data)
            end += len(data)
            digest.update(data)
            so_far = digest.hexdigest()
            declared = h.get("warc-payload-digest", "").removeprefix("sha256:")
            last = left == 0
            if last and row["record_type"] != "revisit" and declared and declared != so_far:
                raise ValueError(f"record {row['record_id']}: its payload does not match its digest")
            yield row | {
                "chunk_no": number, "data": data if with_data else None, "chunk_end": end, "digest_so_far": so_far,
                "last": last, "payload_digest": (declared if row["record_type"] == "revisit" else so_far) if last else None,
            }
            number += 1
            if last:
                break


def read_warc(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """Chunk rows (:data:`CHUNKS`) of the files in a manifest, one file a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[c.split()[1]]) for c in CHUNKS.split(", ")])
        for rows in batches:
            for path in rows.column("path").to_pylist():
                system, place = _place(path)
                with system.open_input_stream(place, compression=None, buffer_size=1 << 20) as raw:
                    with gzip.GzipFile(fileobj=raw) as stream:
                        held, size = [], 0
                        for row in read_records(stream, chunk_bytes, with_data):
                            held.append(row)
                            size += len(row["data"] or b"")
                            if len(held) >= 1000 or size >= 8 * chunk_bytes:
                                yield pa.RecordBatch.from_pylist(held, schema)
                                held, size = [], 0
                        if held:
                            yield pa.RecordBatch.from_pylist(held, schema)

    files = manifest.select("path")
    return files.repartition(max(1, files.count()), "path").mapInArrow(run, CHUNKS)


def archive(pages: DataFrame, folder: str | None = None, **names) -> DataFrame:
    """Plan, cut and write ``pages``; returns the manifest of the archives."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return write_warc(chunk_table(plan_records(pages, **names)), folder)
