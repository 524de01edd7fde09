"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "tallywright", **conf: str) -> SparkSession:
    """A session with adaptive execution on and a UTC session clock.

    The master, memory and shuffle width belong to the cluster and are only set
    when passed in `conf` (dots written as double underscores).
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Recording the calling line of every column makes building a plan several times slower.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
