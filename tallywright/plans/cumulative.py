"""Totals per user and running totals per day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.amounts import MONEY, WHOLE, exact_sum
from tallywright.functions.clock import LOCAL_ZONE, local_day, utc_day
from tallywright.functions.derived import with_full_name
from tallywright.operators.rollups import user_totals

# Balances from before the first stored day.
OPENING_CONTRIBUTIONS = 1872.61
OPENING_FEES = 187.26
OPENING_TRANSACTIONS = 3937


def cumulative_by_user(users: DataFrame, contributions: DataFrame, *, ordered: bool = True) -> DataFrame:
    """Totals, number of contributions and days from first to last; users without rows are absent."""
    totals = user_totals(contributions)
    result = (
        with_full_name(users)
        .select("id", "full_name", "date_joined")
        .join(totals, F.col("id") == F.col("user_id"))
        .select(
            "id",
            "full_name",
            "date_joined",
            F.col("total_contributions").cast(MONEY).alias("total_contributions"),
            F.col("total_fees").cast(MONEY).alias("total_fees"),
            F.col("total_transactions").cast(WHOLE).alias("total_transactions"),
            "num_contributions",
            F.datediff(utc_day("last_timestamp"), utc_day("first_timestamp")).alias("lifespan_days"),
        )
    )
    # The id keeps users with equal fees from piling up in one range partition.
    return result.orderBy(F.desc("total_fees"), "id") if ordered else result


def daily_cumulative(
    contributions: DataFrame,
    *,
    tz: str = LOCAL_ZONE,
    opening_contributions: float = OPENING_CONTRIBUTIONS,
    opening_fees: float = OPENING_FEES,
    opening_transactions: int = OPENING_TRANSACTIONS,
) -> DataFrame:
    """Sums per local day with their running totals, with and without opening balances.

    The window has no partition, but it sees one row per calendar day only.
    """
    daily = (
        contributions.select(
            local_day("timestamp", tz).alias("date"),
            F.coalesce("contribution", F.lit(0.0)).alias("contribution"),
            F.coalesce("fee", F.lit(0.0)).alias("fee"),
            F.coalesce("transaction_count", F.lit(0)).alias("transactions"),
        )
        .groupBy("date")
        .agg(
            exact_sum("contribution").alias("contributions"),
            exact_sum("fee").alias("fees"),
            F.sum("transactions").alias("transactions"),
        )
    )
    so_far = "OVER (ORDER BY date NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    series = [
        ("contributions", exact_sum("contributions", so_far), opening_contributions, MONEY),
        ("fees", exact_sum("fees", so_far), opening_fees, MONEY),
        ("transactions", F.expr(f"sum(transactions) {so_far}"), opening_transactions, WHOLE),
    ]
    running = daily.select("*", *[total.alias(f"running_{name}") for name, total, _, _ in series])
    return running.select(
        "date",
        *[F.col(name).cast(kind).alias(f"daily_{name}") for name, _, _, kind in series],
        *[
            column
            for name, _, opening, kind in series
            for column in (
                F.col(f"running_{name}").cast(kind).alias(f"cumulative_{name}"),
                (F.col(f"running_{name}") + opening).cast(kind).alias(f"adj_cumulative_{name}"),
            )
        ],
    )
