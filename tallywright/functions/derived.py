"""Derived columns of the two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.clock import utc_day


def full_name() -> Column:
    """First and last name; NULL when either part is."""
    return F.concat(F.col("first_name"), F.lit(" "), F.col("last_name"))


def with_full_name(users: DataFrame) -> DataFrame:
    return users.withColumn("full_name", full_name())


def with_contribution_columns(contributions: DataFrame) -> DataFrame:
    """Total with fee, fee percentage (NULL on a zero contribution), UTC day."""
    return contributions.withColumns(
        {
            "total_with_fee": F.expr("contribution + fee"),
            "fee_percentage": F.expr("fee / nullif(contribution, 0) * 100"),
            "contrib_date": utc_day("timestamp"),
        }
    )
