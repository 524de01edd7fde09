"""CSV landing area: which files count, what they must hold, how they become rows."""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.amounts import AMOUNT_LIMIT
from tallywright.schemas import LANDING_COLUMNS
from tallywright.sources.files import escaped, found_by, full_path
from tallywright.sources.headers import headers

# The key layout and the time stamp in file names.
KEY_PATTERN = r"^new_contributions/year=\d{4}/month=\d{2}/day=\d{2}/[^/]+\.csv$"
STAMP_PATTERN = r"_(\d{8})_(\d{6})[^/]*$"
PREFIX = "new_contributions/"

# Numbers as the exporter writes them; underscores may group digits.
_DIGITS = r"\d+(_\d+)*"
DECIMAL_PATTERN = rf"^[+-]?({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"
INTEGER_PATTERN = rf"^[+-]?{_DIGITS}$"
# Every character that counts as blank around a number: Unicode white space and the four separators of ASCII.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Position of a row in the import: file time, then file, then line.
LOAD_ORDER = ("file_ts", "file_key", "file_block", "line")


class LandingError(ValueError):
    """A file or row that fails the whole load."""


def with_stamp(files: DataFrame, path: Column | str = "key") -> DataFrame:
    """Adds `file_ts`, the UTC time in the file name; NULL without a stamp, an error for an impossible one."""
    path = F.col(path) if isinstance(path, str) else path
    digits = F.concat(F.regexp_extract(path, STAMP_PATTERN, 1), F.regexp_extract(path, STAMP_PATTERN, 2))
    return files.withColumn(
        "file_ts", F.when(digits != "", F.to_timestamp_ntz(digits, F.lit("yyyyMMddHHmmss")))
    )


def matching(files: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Files whose `key` starts with `prefix` and follows the key layout; all others are skipped."""
    return files.filter(F.col("key").startswith(prefix) & F.col("key").rlike(KEY_PATTERN))


def _plain(uri: str) -> Column:
    """A file URI as the path that it stands for."""
    return F.url_decode(F.replace(F.col(uri), F.lit("+"), F.lit("%2B")))


def _key(path: str, root: str) -> Column:
    """The part of `path` below the landing root, given in full; empty for a path outside."""
    below = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*(?=/))?", "", root).strip("/")
    start = f"/{re.escape(below)}/" if below else "/"
    return F.regexp_extract(path, rf"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*(?=/))?)?/*{start[1:]}(.*)$", 1).alias("key")


def inventory(files: DataFrame, root: str, prefix: str = PREFIX) -> DataFrame:
    """Importable files of a binary-file listing of `root` (its full path): path, URI, size, key and time stamp.

    File contents are not read: only columns that the listing provides are selected.
    """
    uri = F.col("_metadata.file_path").alias("file_path")
    return with_stamp(matching(files.select("path", uri, "length", _key("path", root)), prefix))


def require_visible(spark: SparkSession, root: str, prefix: str = PREFIX) -> None:
    """Raises for files of the key layout whose names Spark's listing hides (a leading `_` or `.`)."""
    hidden = found_by(spark, f"{escaped(root)}/{PREFIX}year=*/month=*/day=*/[_.]*")
    keys = spark.createDataFrame([(path,) for path in hidden], "path string").select(_key("path", root))
    first = matching(keys, prefix).agg(F.min("key")).first()[0] if hidden else None
    if first is not None:
        raise LandingError(f"{first}: names that start with _ or . are hidden from Spark; rename the file")


def list_files(spark: SparkSession, root: str, prefix: str = PREFIX) -> DataFrame:
    """Inventory of everything below `root`.

    A file of no bytes has no header and therefore none of the required columns.
    Scans leave such files out, so they are found by comparing with the names. A file that the
    listing spells in a way that does not start with the root is an error, not a file to skip.
    """
    root = full_path(spark, root)
    require_visible(spark, root, prefix)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(escaped(root))
    found = inventory(listing, root, prefix)
    names = spark.createDataFrame([(unquote(uri),) for uri in listing.inputFiles()], "path string")
    keys = names.select("path", _key("path", root))
    outside = keys.filter("key = ''").agg(F.min("path")).first()[0]
    if outside is not None:
        raise LandingError(f"{outside}: not below {root}")
    empty = matching(keys, prefix).join(found, "key", "left_anti").agg(F.min("key")).first()[0]
    if empty is not None:
        raise LandingError(f"{empty}: missing columns: {sorted(LANDING_COLUMNS)}")
    return found


def _layouts(spark: SparkSession, files: Sequence[Row]) -> dict[tuple[str, ...], list[str]]:
    """Paths by column names. Holds one entry per file on the driver, as the file listing itself does."""
    first_lines = headers(spark, files)
    layouts = defaultdict(list)
    for file in files:
        header = first_lines.get(file["file_path"]) or ""
        names = tuple(next(csv.reader([header.lstrip("\ufeff")]), []))
        missing = sorted(set(LANDING_COLUMNS) - set(names))
        if missing:
            raise LandingError(f"{file['key']}: missing columns: {missing}")
        layouts[names].append(file["path"])
    return layouts


def _read_layout(spark: SparkSession, names: Sequence[str], paths: Sequence[str], multi_line: bool) -> DataFrame:
    positions = {name: i for i, name in enumerate(names)}
    rows = (
        spark.read.schema(", ".join(f"c{i} string" for i in range(len(names))))
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv([escaped(p) for p in paths])
    )
    return rows.select(
        *[F.col(f"c{positions[name]}").alias(name) for name in LANDING_COLUMNS],
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_block"),
        F.monotonically_increasing_id().alias("line"),
    )


def read_files(spark: SparkSession, files: Sequence[Row], *, multi_line: bool = False) -> DataFrame:
    """Raw (string) rows of listed files with their load order.

    `multi_line` takes line breaks inside quoted fields; a file is then read by one task.

    Columns are found by name in each file's header, so files may order them
    differently or carry more. A file without a stamp or without a required
    column is an error.
    """
    unstamped = sorted(f["key"] for f in files if f["file_ts"] is None)
    if unstamped:
        raise LandingError(f"file names without a _YYYYMMDD_HHMMSS stamp: {unstamped[:10]}")
    layouts = _layouts(spark, sorted(files, key=lambda f: f["key"]))
    parts = [_read_layout(spark, names, paths, multi_line) for names, paths in layouts.items()]
    rows = reduce(DataFrame.unionByName, parts).withColumn("file_key", _plain("file_path"))
    return with_stamp(rows, "file_key")


def _number(column: str, pattern: str, kind: str) -> Column:
    """The number in a text with any blank characters around it; NULL where there is none or it is too large."""
    text = F.trim(column, F.lit(BLANKS))
    number = F.when(text.rlike(pattern), F.translate(text, "_", "").try_cast(kind))
    return F.when(F.abs(number) < AMOUNT_LIMIT, number) if kind == "double" else number


def checked(raw: DataFrame) -> DataFrame:
    """Typed columns next to the raw ones, and `problem`: why a row is bad, NULL when it is not."""
    typed = raw.withColumns(
        {
            "contribution": _number("amount", DECIMAL_PATTERN, "double"),
            "fee": _number("fee_total", DECIMAL_PATTERN, "double"),
            "transactions": _number("transaction_count", INTEGER_PATTERN, "int"),
        }
    )
    return typed.withColumn(
        "problem",
        F.when(F.col("contribution").isNull(), "amount is not a decimal")
        .when(F.col("fee").isNull(), "fee_total is not a decimal")
        .when(F.col("transactions").isNull(), "transaction_count is not an integer")
        .when(F.coalesce(F.col("customer_id"), F.lit("")) == "", "customer_id is empty"),
    )


def rejects(rows: DataFrame) -> DataFrame:
    """The bad rows of `checked`, for diagnosis."""
    return rows.filter("problem IS NOT NULL")


def accepted(rows: DataFrame) -> DataFrame:
    """The good rows of `checked` as contribution input, with their load order."""
    return rows.filter("problem IS NULL").select(
        F.col("file_ts").alias("timestamp"),
        F.col("customer_id").alias("user_id"),
        "contribution",
        "fee",
        F.col("transactions").alias("transaction_count"),
        *LOAD_ORDER,
    )


def require_clean(rows: DataFrame) -> None:
    """Raises when `checked` found any bad row, naming the first ones' file and reason."""
    first = F.min(F.struct("file_path", "problem")).alias("first")
    bad = rejects(rows).agg(F.count(F.lit(1)).alias("n"), first).first()
    if bad["n"]:
        raise LandingError(f"{bad['first']['file_path']}: {bad['first']['problem']} ({bad['n']} bad rows in this load)")
