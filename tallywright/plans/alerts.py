"""Anti-money-laundering alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.amounts import exact_sum
from tallywright.functions.clock import utc_day
from tallywright.functions.derived import with_full_name

# Thresholds and windows of the two rules.
ANNIVERSARY_THRESHOLD = 8000
DAYS_PER_YEAR = 365.25
WEEKLY_THRESHOLD = 350
DAYS_BACK = 6


def anniversary_totals_over(
    users: DataFrame,
    contributions: DataFrame,
    *,
    threshold: float = ANNIVERSARY_THRESHOLD,
    ordered: bool = True,
) -> DataFrame:
    """Users whose contributions within one year of membership exceed `threshold`.

    Years are 365.25 days long, but labelled with calendar anniversaries. The
    join leaves the rows partitioned by user, so the aggregation needs no further
    shuffle. Stored contributions have one row per user and day, which leaves nothing
    to combine before it and bounds a user by the calendar.
    """
    members = with_full_name(users).filter("date_joined IS NOT NULL").select("id", "full_name", "date_joined")
    year = F.floor(F.datediff("day", "date_joined") / DAYS_PER_YEAR).cast("int")
    result = (
        contributions.select("user_id", utc_day("timestamp").alias("day"), "contribution")
        .join(members, F.col("user_id") == F.col("id"))
        .groupBy("user_id", "full_name", "date_joined", year.alias("year"))
        .agg(exact_sum("contribution").alias("total_contribution"))
        .filter(F.col("total_contribution") > threshold)
        .select(
            "user_id",
            "full_name",
            F.add_months("date_joined", F.col("year") * 12).alias("period_start"),
            F.add_months("date_joined", F.col("year") * 12 + 12).alias("period_end"),
            "total_contribution",
        )
    )
    return result.orderBy("user_id", "period_start") if ordered else result


def weekly_transactions_over(
    contributions: DataFrame,
    *,
    threshold: int = WEEKLY_THRESHOLD,
    days_back: int = DAYS_BACK,
    stretch_days: int = 56,
    ordered: bool = True,
) -> DataFrame:
    """Users and days whose trailing transaction count exceeds `threshold`.

    The window covers [t - days_back days, t] on timestamps, both ends included.
    A user's history is cut into stretches of `stretch_days`, and rows near the
    end of one are repeated at the front of the next, so a long history is spread
    over tasks and every window is still whole inside its stretch.

    Rows sharing user and timestamp each count the window once, as in a
    self-join; the grouping behind the window keeps its partitioning.
    """
    day_number = F.unix_date(utc_day("timestamp"))
    own = F.floor(day_number / stretch_days)
    following = F.floor((day_number + days_back) / stretch_days)
    stretches = F.sequence(own, following)
    spread = (
        contributions.filter("timestamp IS NOT NULL")
        .select("user_id", "timestamp", "transaction_count", own.alias("own"), F.explode(stretches).alias("stretch"))
    )
    trailing = F.expr(
        "sum(transaction_count) OVER (PARTITION BY user_id, stretch ORDER BY timestamp "
        f"RANGE BETWEEN INTERVAL '{int(days_back)}' DAY PRECEDING AND CURRENT ROW)"
    )
    result = (
        spread.withColumn("trailing", trailing)
        .filter("stretch = own")
        .groupBy("user_id", "stretch", "timestamp")
        .agg(F.sum("trailing").alias("weekly_transaction_count"))
        .filter(F.col("weekly_transaction_count") > threshold)
        .select("user_id", utc_day("timestamp").alias("period_end"), "weekly_transaction_count")
    )
    return result.orderBy("user_id", "period_end") if ordered else result
