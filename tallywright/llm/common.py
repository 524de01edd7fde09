"""What several operators of this folder share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_GAP = r"[^\p{L}\p{N}]+"

Batches = Iterator[pa.RecordBatch]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.checkpoint.dir`.

    Only where the cluster names none (tests) the context's checkpoint folder or, on a
    local master, a new temporary one stands in.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = tempfile.mkdtemp(prefix="tallywright-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: the lineage ends here.

    The files outlive lost executors and go with the cluster's clean-up of that folder.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows that each end with the row by which their sizes add up to `most`."""
    start = held = 0
    for end, size in enumerate(sizes, 1):
        held += size
        if held >= most or end == len(sizes):
            yield start, end
            start, held = end, 0


def giving_back(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """`work`, after which Arrow frees what it took: workers stay for other jobs, and executors' memory is theirs too."""

    def task(batches: Batches) -> Batches:
        yield from work(batches)
        pa.default_memory_pool().release_unused()

    return task


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; no words for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")


def extended(df: DataFrame, more: str) -> T.StructType:
    """The schema of `df` with the columns of a DDL string behind it, all nullable."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema] + T.StructType.fromDDL(more).fields)


def place_of(df: DataFrame, name: str) -> int:
    """The position of a column, as the same name in another case may come twice in a batch."""
    return df.columns.index(df.select(name).columns[0])
