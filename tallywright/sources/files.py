"""The few file-system operations that DataFrames do not offer, on any file system that Spark reads."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _is(error: Py4JJavaError, name: str) -> bool:
    return error.java_exception.getClass().getSimpleName() == name


def escaped(path: str) -> str:
    """`path` as a pattern that matches nothing but itself."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def full_path(spark: SparkSession, path: str) -> str:
    """`path` as the file system spells it: with scheme, without dots and doubled slashes; relative ones resolved."""
    files, place = _open(spark, path)
    return files.makeQualified(place).toString()


def found_by(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, also those of hidden files."""
    files, place = _open(spark, pattern)
    return [status.getPath().toString() for status in files.globStatus(place) or []]


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds; none where there is no folder."""
    files, place = _open(spark, folder)
    try:
        return sorted(status.getPath().getName() for status in files.listStatus(place))
    except Py4JJavaError as error:
        if _is(error, "FileNotFoundException"):
            return []
        raise


def read_small(spark: SparkSession, path: str) -> str:
    files, place = _open(spark, path)
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small new file that appears whole or not at all; False, and nothing changed, where there is one already.

    The text goes to a file of another name first, which is then renamed without replacing.
    """
    files, place = _open(spark, path)
    written = place.suffix(f".{uuid.uuid4().hex}.tmp")
    stream = files.create(written, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    no_options = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(place.toUri(), context._jsc.hadoopConfiguration()).rename(
            files.makeQualified(written), files.makeQualified(place), no_options
        )
    except Py4JJavaError as error:
        files.delete(written, False)
        if _is(error, "FileAlreadyExistsException"):
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    files, place = _open(spark, path)
    files.delete(place, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Gives a file another name, in a folder that is made where there is none."""
    files, place = _open(spark, path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    files.mkdirs(target.getParent())
    if not files.rename(place, target):
        raise OSError(f"{path} cannot be moved to {to}")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; a temporary one only on a local master."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir is not set")
    return (folder or tempfile.mkdtemp(prefix="tallywright-")).rstrip("/")
