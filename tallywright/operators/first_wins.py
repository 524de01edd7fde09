"""Insert-or-ignore on a unique key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USER_DAY = ("user_id", "contrib_date")


def first_wins(rows: DataFrame, order: Sequence[Column | str], key: Sequence[str] = USER_DAY) -> DataFrame:
    """The first row of every key in `order`; all others are ignored.

    The rank limit runs before the shuffle as well as after it (Spark's window
    group limit), so at most one row per key leaves a map task: a key that holds
    a large share of all rows does not land in one reducer.
    """
    window = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def not_stored(rows: DataFrame, stored: DataFrame, key: Sequence[str] = USER_DAY) -> DataFrame:
    """Rows whose key the stored table does not hold yet."""
    return rows.join(stored.select(*key), list(key), "left_anti")
