"""First lines of many files, for the price of one short read a file."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallywright.sources.files import escaped

BLOCK = 16 * 1024
FILES_PER_TASK = 1_000


def by_range(spark: SparkSession, files: Sequence[Row], block: int = BLOCK) -> DataFrame:
    """(file_path, header, bytes_read) of listed files, read by byte range in tasks that share the files out.

    A first line longer than `block` takes further blocks. Files that Python cannot open here
    (its file systems have neither all of Spark's schemes nor its settings) get a NULL header.
    """
    named = spark.createDataFrame([(f["path"], f["file_path"]) for f in files], "path string, file_path string")
    tasks = max(1, min(len(files), max(spark.sparkContext.defaultParallelism, len(files) // FILES_PER_TASK)))

    # Travels with its tasks: uses nothing of this module but `block`.
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import pyarrow as pa
        from pyarrow import fs

        places: dict[tuple[str, str], tuple[fs.FileSystem, str] | None] = {}

        def place(scheme: str, authority: str) -> tuple[fs.FileSystem, str]:
            if scheme in ("", "file"):
                return fs.LocalFileSystem(), ""
            known = {"hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}[scheme]
            return fs.FileSystem.from_uri(f"{known}://{authority}/")[0], "" if known == "hdfs" else authority

        def first_line(path: str) -> tuple[str | None, int]:
            scheme, authority, below = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/]*))?(/.*)", path, re.S).groups("")
            at = (scheme, authority)
            try:
                if at not in places:
                    places[at] = None  # stays where there is no such file system: it is tried once a task
                    places[at] = place(*at)
                if places[at] is None:
                    return None, 0
                files, above = places[at]
                found, size = b"", 0
                with files.open_input_file(above + below) as file:
                    while True:
                        part = file.read_at(block, size)
                        found, size = found + part, size + len(part)
                        end = re.search(rb"[\r\n]", found)
                        if end or len(part) < block:
                            return found[: end.start() if end else size].decode("utf-8", "replace"), size
            except (OSError, KeyError, ValueError, pa.ArrowException):
                places[at] = places[at] if scheme in ("", "file") else None
                return None, 0

        for batch in batches:
            lines = [first_line(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file_path"), pa.array([h for h, _ in lines], pa.string()), pa.array([n for _, n in lines], pa.int64())],
                ["file_path", "header", "bytes_read"],
            )

    return named.repartition(tasks).mapInArrow(read, "file_path string, header string, bytes_read long")


def by_scan(spark: SparkSession, files: Sequence[Row]) -> DataFrame:
    """(file_path, header) of listed files through Spark's own reader, which reads all of their bytes."""
    lines = spark.read.text([escaped(f["path"]) for f in files]).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    return lines.filter("block = 0").groupBy("file_path").agg(F.min_by("value", "line").alias("header"))


def headers(spark: SparkSession, files: Sequence[Row], block: int = BLOCK) -> dict[str, str]:
    """The first line of every listed file by its URI; files out of Python's reach are read by Spark."""
    found = {row["file_path"]: row["header"] for row in by_range(spark, files, block).collect()} if files else {}
    rest = [f for f in files if found[f["file_path"]] is None]
    return found | (dict(by_scan(spark, rest).collect()) if rest else {})
