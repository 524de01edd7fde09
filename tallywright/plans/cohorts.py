"""Retention by month of joining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.amounts import count_ratio, round_half_up
from tallywright.functions.clock import LOCAL_ZONE, local_month


def cohort_retention(
    users: DataFrame, contributions: DataFrame, *, tz: str = LOCAL_ZONE, ordered: bool = True
) -> DataFrame:
    """Share of every joining cohort active in each later month.

    Cohorts go by the (UTC) joining date, activity by the local month. Activity
    before the cohort month is dropped; the size counts silent users as well.
    """
    joined = users.filter("date_joined IS NOT NULL").select("id", F.trunc("date_joined", "MM").alias("cohort"))
    # One row per calendar month: small enough to broadcast by construction.
    sizes = joined.groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_size"))

    # After the distinct a user has one row per month, so a plain count is a
    # distinct count and a busy user is no heavier than its months.
    months = contributions.select("user_id", local_month("timestamp", tz).alias("month")).distinct()
    active = (
        months.join(joined, (F.col("user_id") == F.col("id")) & (F.col("month") >= F.col("cohort")))
        .groupBy("cohort", "month")
        .agg(F.count(F.lit(1)).alias("active_users"))
    )
    share = count_ratio(F.col("active_users") * 100, F.col("cohort_size"))
    result = active.join(F.broadcast(sizes), "cohort").select(
        F.date_format("cohort", "yyyy-MM").alias("cohort_month"),
        F.expr("CAST(12 * (year(month) - year(cohort)) + month(month) - month(cohort) AS BIGINT) AS months_since_join"),
        "active_users",
        "cohort_size",
        round_half_up(share, 1).cast("decimal(10,1)").alias("pct_retained"),
    )
    return result.orderBy("cohort_month", "months_since_join") if ordered else result
