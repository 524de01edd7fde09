"""Pre-aggregations that the reports build on.

Days combine on the map side first, so that a busy day does not reach a reducer as
raw rows; users are no longer than the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.amounts import exact_sum
from tallywright.functions.clock import LOCAL_ZONE, local_day


def user_totals(contributions: DataFrame) -> DataFrame:
    """One row per user: exact totals, row count, first and last timestamp."""
    return contributions.groupBy("user_id").agg(
        exact_sum("contribution").alias("total_contributions"),
        exact_sum("fee").alias("total_fees"),
        F.sum("transaction_count").alias("total_transactions"),
        F.count(F.lit(1)).alias("num_contributions"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )


def user_days(contributions: DataFrame, tz: str = LOCAL_ZONE) -> DataFrame:
    """One row per user and local day: exact sums.

    Rows are dealt out by user alone, so that what follows by user needs no further
    shuffle. Stored contributions have one row per user and UTC day: there is nothing to
    combine before the shuffle, and no user is longer than the calendar.
    """
    needed = contributions.select("user_id", "timestamp", "contribution", "fee")
    return needed.repartition("user_id").groupBy("user_id", local_day("timestamp", tz).alias("day")).agg(
        exact_sum("contribution").alias("contribution"), exact_sum("fee").alias("fee")
    )


def daily_stats(per_user_day: DataFrame) -> DataFrame:
    """Users, sums and fee per user for every day of `user_days`."""
    stats = per_user_day.groupBy("day").agg(
        F.count(F.lit(1)).alias("daily_users"),
        exact_sum("contribution").alias("daily_contributions"),
        exact_sum("fee").alias("daily_fees"),
    )
    return stats.withColumn("daily_arpu", F.col("daily_fees") / F.col("daily_users"))
