"""Exact duplicates by progressive refinement.

Texts are told apart by length, then by a hash of their first characters, then by the
SHA-256 of the whole. One scan takes length and prefix of every row, of which only counts
are shuffled; groups of one row are settled there. The second scan hashes whole texts only
of rows whose group survived, and narrow rows (id, size, digest) go on: a text never
leaves the task that reads it.

Which groups survived reaches the second scan as a bitmap of fixed size, so nothing
that is broadcast grows with the data. A row that passes it by chance is hashed and found
to be alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm import bitmaps
from tallywright.llm.common import stored

PREFIX_CHARS = 64


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with __body, __size (bytes) and __head (a hash of size and first characters)."""
    body = F.coalesce(F.col(text), F.lit(""))
    head = F.xxhash64(F.octet_length(body), F.substring(body, 1, PREFIX_CHARS))
    return docs.withColumns({"__body": body, "__size": F.octet_length(body).cast("long"), "__head": head})


def _surviving_heads(measured: DataFrame) -> DataFrame:
    """(head): the prefix hashes that several rows of one length share."""
    counted = stored(measured.groupBy("__size", "__head").agg(F.count(F.lit(1)).alias("n")), "prefix-groups")
    lengths = counted.groupBy("__size").agg(F.sum("n").alias("all")).filter(F.col("all") > 1).select("__size")
    return counted.join(lengths, "__size", "left_semi").filter("n > 1").select(F.col("__head").alias("head"))


def _digested(docs: DataFrame, key: str, text: str, row: Column, every_digest: bool) -> DataFrame:
    """(key, row, size, survived, digest) of every row; digest only where needed."""
    measured = _measured(docs, text)
    bitmap = bitmaps.parts(_surviving_heads(measured), "head")
    flagged = bitmaps.perhaps_in(measured, "__head", bitmap, "__survived")
    digest = F.sha2(F.encode("__body", "UTF-8"), 256)
    if not every_digest:
        digest = F.when(F.col("__survived"), digest)
    narrow = flagged.select(
        F.col(key).alias("key"), row.alias("row"), F.col("__size").alias("size"), F.col("__survived").alias("survived"), digest.alias("digest")
    )
    return stored(narrow, "digested-rows")


def _grouped(docs: DataFrame, key: str, text: str, row: Column, every_digest: bool) -> DataFrame:
    rows = _digested(docs, key, text, row, every_digest)
    met = rows.filter("survived")
    groups = met.groupBy("size", "digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("key", "row")).alias("last")
    )
    # A group may hold a third of all rows: merged, so that adaptive execution can split it.
    several = met.join(groups.hint("merge"), ["size", "digest"])
    shared = several.select(
        "key", "row", "size", "digest", F.col("last.key").alias("keep_id"), "group_size", (F.col("last.row") == F.col("row")).alias("kept")
    )
    alone = rows.filter("NOT survived").select(
        "key", "row", "size", "digest", F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    return shared.union(alone)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", every_digest: bool = False) -> DataFrame:
    """(key, keep_id, group_size, kept, size, digest) of every row, under the name of the `key` column.

    Texts are equal if their bytes are; null counts as the empty text. Of equal texts the row
    with the largest key stays; a null key is smaller than any other, and of rows that repeat
    key and text exactly one stays. `digest` is the SHA-256 in hex, null for rows that were
    told apart before it was needed unless `every_digest` is set. Other columns of `docs` are
    not read, so their names cannot clash. An empty table gives no rows.
    """
    grouped = _grouped(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", F.monotonically_increasing_id(), every_digest)
    name = docs.select(key).columns[0]
    return grouped.select(F.col("key").alias(name), "keep_id", "group_size", "kept", "size", "digest")


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Rows are numbered in a stored copy, so that rows that repeat as a whole are told apart.
    """
    numbered = stored(docs.withColumn("__exact_row", F.monotonically_increasing_id()), "numbered-rows")
    source = numbered.select(F.col(key).alias("key"), F.col(text).alias("text"), "__exact_row")
    gone = _grouped(source, "key", "text", F.col("__exact_row"), False).filter(~F.col("kept")).select(F.col("row").alias("__exact_row"))
    return numbered.join(gone, "__exact_row", "left_anti").select(*[numbered[f"`{c}`"] for c in docs.columns])
