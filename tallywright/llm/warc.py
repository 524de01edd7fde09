"""WARC archives as a table of chunks.

A record is never one value on the reading side: the reader streams each archive
and yields (record, chunk number) rows whose digest and byte count cover the
payload up to and including that chunk, so the row marked `is_last` speaks for the
whole record. A task holds one chunk and one output batch at a time, whatever a
record's size.

Records of equal payload are written once: the one with the largest id as
`response`, the others as `revisit` without a body. Archives hold one gzip member
a record and go to a folder that all executors share; a file is written under a
name of its own attempt and moved into place, so a task that is run again replaces
its files by equal ones.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import scratch_path, stored

CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 512 << 20
SMALLEST_REVISIT = 1000
_BATCH_BYTES = 4 << 20
_BATCH_ROWS = 2000

MANIFEST = "path string, records long, archive_bytes long"
CHUNKS = (
    "record_id string, record_type string, target_uri string, refers_to string, chunk_no long, is_last boolean,"
    " data binary, payload_bytes long, payload_digest string, intact boolean"
)


def with_digest(pages: DataFrame, payload: str) -> DataFrame:
    """Adds the UTF-8 payload (null: empty), its size and its SHA-1."""
    return pages.withColumn("payload", F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")}
    )


def records(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """One row per page: key, uri, payload, payload_bytes, payload_digest, refers_to.

    `refers_to` is the largest key among equal payloads of SMALLEST_REVISIT bytes or more
    where that is another key, else null. Rows that repeat a whole page are all responses.
    Only digests that occur more than once are joined back, from a stored table, so that the
    planner knows its size: payloads are shuffled only where it is too large to broadcast. A null key never is the response of other pages.
    """
    plain = pages.select(F.col(key).alias("key"), F.col(uri).alias("uri"), F.col(payload).alias("html"))
    found = with_digest(plain, "html").drop("html")
    repeated = stored(
        found.filter(F.col("payload_bytes") >= SMALLEST_REVISIT)
        .groupBy("payload_digest")
        .agg(F.max("key").alias("first_key"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n"),
        "repeated-payloads",
    )
    first = F.when(F.col("payload_bytes") >= SMALLEST_REVISIT, F.col("first_key"))
    return (
        found.join(repeated, "payload_digest", "left")
        .withColumn("refers_to", F.when(~first.eqNullSafe(F.col("key")), first))
        .drop("first_key")
    )


def to_chunks(found: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of `records` cut into chunk rows, in order; a revisit is one empty chunk."""
    stored_bytes = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0)
    last = F.greatest(F.ceil(stored_bytes / chunk_bytes) - 1, F.lit(0).cast("long"))
    return (
        found.withColumn("last_no", last)
        .withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_no"))))
        .select(
            F.col("key").cast("string").alias("key"),
            F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\x00-\x20\x7f]+", "%20").alias("uri"),
            "payload_bytes",
            "payload_digest",
            F.col("refers_to").cast("string").alias("refers_to"),
            "chunk_no",
            (F.col("chunk_no") == F.col("last_no")).alias("is_last"),
            F.when(
                F.col("refers_to").isNull(),
                F.expr(f"substring(payload, cast(chunk_no * {chunk_bytes} + 1 as int), {chunk_bytes})"),
            ).alias("data"),
        )
    )


def _head(row: dict) -> bytes:
    """The WARC and HTTP header lines of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    revisit = row["refers_to"] is not None
    length = len(http.encode()) + (0 if revisit else row["payload_bytes"])
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if row['key'] is None else row['key']}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {row['uri']}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {length}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{row['refers_to']}>",
        ]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


class _Archive:
    """One archive file of a task, moved into place when it is closed."""

    def __init__(self, folder: str, name: str):
        self.files, root = pa.fs.FileSystem.from_uri(folder)
        self.files.create_dir(root, recursive=True)
        self.path, self.place = f"{folder}/{name}", f"{root}/{name}"
        self.own = f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.own, compression=None)
        self.records = self.bytes = 0
        self.member = None

    def write(self, data: bytes) -> None:
        self.member = self.member or zlib.compressobj(wbits=31)
        self._put(self.member.compress(data))

    def end_record(self) -> None:
        self.write(b"\r\n\r\n")
        self._put(self.member.flush())
        self.member = None
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def close(self) -> dict:
        self.out.close()
        if self.files.get_file_info(self.place).type != pa.fs.FileType.NotFound:
            self.files.delete_file(self.place)
        self.files.move(self.own, self.place)
        return {"path": self.path, "records": self.records, "archive_bytes": self.bytes}


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes chunk rows (whole records, in order, within a partition) and lists the archives."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, archive, made, number = TaskContext.get().partitionId(), None, [], 0
        for batch in batches:
            heads = batch.drop_columns(["data"]).to_pylist()
            for row, data in zip(heads, batch.column("data"), strict=True):
                if row["chunk_no"] == 0:
                    if archive is None:
                        archive, number = _Archive(folder, f"part-{task:06d}-{number:04d}.warc.gz"), number + 1
                    archive.write(_head(row))
                if data.is_valid and len(data.as_buffer()):
                    archive.write(data.as_buffer())
                if row["is_last"]:
                    archive.end_record()
                    if archive.bytes >= archive_bytes:
                        made, archive = [*made, archive.close()], None
        if archive is not None:
            made.append(archive.close())
        if made:
            yield pa.RecordBatch.from_pylist(made)

    return chunks.mapInArrow(write, MANIFEST)


def _lines(stream) -> dict[str, str]:
    """Header lines up to the empty one; names in lower case."""
    found = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.lower()] = value.strip()
    return found


def _bare(value: str | None) -> str | None:
    return None if value is None else value.strip("<>")


def archive_chunks(stream, chunk_bytes: int) -> Iterator[dict]:
    """Chunk rows of an archive (a readable binary stream), one record after the other."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        head, start = _lines(stream), stream.tell()
        end = start + int(head["content-length"])
        http = _lines(stream)
        told = head.get("warc-payload-digest", "").removeprefix("sha1:")
        told = base64.b32decode(told).hex() if told else None
        base = {
            "record_id": _bare(head.get("warc-record-id")),
            "record_type": head.get("warc-type"),
            "target_uri": head.get("warc-target-uri"),
            "refers_to": _bare(head.get("warc-refers-to")),
        }
        if base["record_type"] == "revisit":
            size = int(http.get("content-length", 0))
            yield base | {"chunk_no": 0, "is_last": True, "data": b"", "payload_bytes": size, "payload_digest": told, "intact": True}
        else:
            digest, size, number = hashlib.sha1(), 0, 0
            while True:
                data = stream.read(min(chunk_bytes, end - stream.tell()))
                digest.update(data)
                size += len(data)
                last = stream.tell() >= end
                if not data and not last:
                    raise EOFError(f"record {base['record_id']} ends early")
                so_far = digest.hexdigest()
                yield base | {"chunk_no": number, "is_last": last, "data": data, "payload_bytes": size, "payload_digest": so_far, "intact": (told in (None, so_far)) if last else None}
                number += 1
                if last:
                    break


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives in `manifest` (path); one task per archive.

    Without `with_data` payloads are read and digested but not returned.
    """
    files = manifest.select("path").repartition(max(1, manifest.count()))
    schema = pa.schema(
        [
            ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
            ("refers_to", pa.string()), ("chunk_no", pa.int64()), ("is_last", pa.bool_()), ("data", pa.binary()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, place = pa.fs.FileSystem.from_uri(path)
                with files.open_input_file(place) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in archive_chunks(stream, chunk_bytes):
                        if not with_data:
                            row["data"] = None
                        rows.append(row)
                        held += len(row["data"] or b"")
                        if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(read, CHUNKS)


def archive_round_trip(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """Writes a record per page and reads the archives back as chunk rows.

    Null keys, URIs and payloads, empty tables, repeated rows and further columns are all
    taken; the last are not archived.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    manifest = stored(write_archives(to_chunks(records(pages, key, uri, payload)), folder), "warc-manifest")
    return read_archives(manifest)


def record_table(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk; a record that is not what its header says fails the job."""
    page = lambda c: F.regexp_replace(c, "^urn:page:", "")
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    checked = F.when(F.col("intact"), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload digest differs: "), F.col("record_id")))
    )
    return chunks.filter("is_last").select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        checked.alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        (F.col("chunk_no") + 1).alias("chunks"),
    )
