"""Medians over recently active users."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.clock import session_today, utc_day
from tallywright.operators.median import exact_medians
from tallywright.operators.rollups import user_totals


def medians(
    users: DataFrame, contributions: DataFrame, *, as_of: date | None = None, active_days: int = 7
) -> DataFrame:
    """One row: median daily contribution, median daily fee, median fee share, ratio of the first two.

    Users count when their last contribution (UTC day) is at most `active_days`
    old, which leaves out those without any; the inactive are dropped before the
    join. A user who joined today, in the future or at an unknown date has daily
    rate 0.
    """
    today = session_today(as_of)
    active = user_totals(contributions).filter(F.datediff(today, utc_day("last_timestamp")) <= active_days)
    joined = users.select("id", "date_joined").join(active, F.col("id") == F.col("user_id"))

    contributed = F.coalesce("total_contributions", F.lit(0.0))
    paid = F.coalesce("total_fees", F.lit(0.0))
    days = F.datediff(today, F.col("date_joined"))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    rates = joined.select(
        share(contributed, days).alias("median_daily_contribution"),
        share(paid, days).alias("median_daily_fee"),
        share(paid, contributed).alias("median_of_per_user_fee_percentages"),
    )
    middle = exact_medians(rates, rates.columns)
    ratio = F.when(
        F.col("median_daily_contribution") > 0, F.col("median_daily_fee") / F.col("median_daily_contribution")
    )
    return middle.withColumn("percentage_of_medians", ratio)
