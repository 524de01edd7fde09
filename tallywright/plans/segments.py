"""Classes of users by monthly rate."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.amounts import round_half_even
from tallywright.functions.clock import session_today, utc_day
from tallywright.functions.derived import with_full_name
from tallywright.operators.moments import exact_moments
from tallywright.operators.rollups import user_totals

# Fixed value: mean days per month.
DAYS_PER_MONTH = 30.44
# Part of a rate or mean by which doubles of the same fifteen digits may differ.
ROUNDING = 1e-14


def whales_minnows(
    users: DataFrame,
    contributions: DataFrame,
    *,
    as_of: date | None = None,
    active_days: int = 7,
    ordered: bool = True,
) -> DataFrame:
    """Totals, daily and monthly rates and the class of every user, by fee and by contribution.

    More than one standard deviation above the mean is a whale, below it a
    minnow, between them a dolphin; mean and (population) deviation cover all
    users. Whoever has not contributed for more than `active_days` is inactive.
    """
    today = session_today(as_of)
    totals = user_totals(contributions).select(
        "user_id",
        F.col("total_fees").alias("fee_sum"),
        F.col("total_contributions").alias("contribution_sum"),
        utc_day("last_timestamp").alias("last_contribution_date"),
    )
    joined = (
        with_full_name(users)
        .select("id", "full_name", "date_joined")
        .join(totals, F.col("id") == F.col("user_id"), "left")
        .withColumn("days_since_joining", F.datediff(today, F.col("date_joined")))
    )
    measures = ("fee", "contribution")

    def daily(measure: str) -> Column:
        total = F.coalesce(F.col(f"{measure}_sum"), F.lit(0.0))
        return F.when(F.col("days_since_joining") > 0, total / F.col("days_since_joining")).otherwise(0.0)

    rates = joined.select(
        "id",
        "full_name",
        "date_joined",
        "last_contribution_date",
        F.datediff(today, F.col("last_contribution_date")).alias("days_since_last_contribution"),
        "days_since_joining",
        *[F.coalesce(f"{m}_sum", F.lit(0.0)).alias(f"total_{m}s") for m in measures],
        *[daily(m).alias(f"daily_average_{m}") for m in measures],
        *[(daily(m) * DAYS_PER_MONTH).alias(f"monthly_average_{m}") for m in measures],
    )
    # One row: safe to broadcast. Counting the users seen makes this branch read
    # the same columns as the main one, so Spark reuses the per-user shuffle and
    # reads the contributions once.
    seen = F.count("last_contribution_date").alias("users_seen")
    levels = exact_moments(rates, [f"monthly_average_{m}" for m in measures], seen)

    def user_class(measure: str) -> Column:
        rate = F.col(f"monthly_average_{measure}")
        mean, spread = F.col(f"mean_monthly_average_{measure}"), F.col(f"spread_monthly_average_{measure}")
        away = F.col("days_since_last_contribution")
        # Rates are doubles, the mean has fifteen digits: who is on the border up to the last digits has not crossed it.
        slack = F.greatest(F.abs(rate), F.abs(mean)) * ROUNDING
        return (
            F.when((F.col("users_seen") == 0) | away.isNull() | (away > active_days), "inactive")
            .when(rate - mean - spread > slack, "whale")
            .when(mean - rate - spread > slack, "minnow")
            .otherwise("dolphin")
        )

    classed = rates.crossJoin(F.broadcast(levels))
    if ordered:
        # The id keeps users with equal rates from piling up in one range partition.
        classed = classed.orderBy(F.desc("monthly_average_fee"), "id")
    return classed.select(
        F.col("id").alias("user_id"),
        "full_name",
        "date_joined",
        "last_contribution_date",
        "days_since_last_contribution",
        *[round_half_even(F.col(f"total_{m}s")).alias(f"total_{m}s") for m in measures],
        "days_since_joining",
        *[
            round_half_even(F.col(f"{span}_average_{m}")).alias(f"{span}_average_{m}")
            for span in ("daily", "monthly")
            for m in measures
        ],
        *[user_class(m).alias(f"user_class_by_{m}") for m in measures],
    )
