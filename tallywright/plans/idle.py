"""Users who stopped contributing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.clock import session_today, utc_day
from tallywright.functions.derived import with_full_name


def idle_users(
    users: DataFrame,
    contributions: DataFrame,
    *,
    as_of: date | None = None,
    more_than_days: int = 14,
    ordered: bool = True,
) -> DataFrame:
    """Last contribution more than `more_than_days` UTC days ago; users without any are absent."""
    days = F.datediff(session_today(as_of), utc_day("last_contribution_date"))
    last = (
        contributions.groupBy("user_id")
        .agg(F.max("timestamp").alias("last_contribution_date"))
        .withColumn("days_since_last_contribution", days)
        .filter(F.col("days_since_last_contribution") > more_than_days)
    )
    result = (
        with_full_name(users)
        .select("id", "full_name")
        .join(last, F.col("id") == F.col("user_id"))
        .drop("user_id")
    )
    return result.orderBy(F.desc("days_since_last_contribution"), "id") if ordered else result
