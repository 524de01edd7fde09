"""New, returning, idle and active users per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.clock import LOCAL_ZONE, local_day


def new_returning_daily(
    contributions: DataFrame, *, tz: str = LOCAL_ZONE, idle_after_days: int = 14, ordered: bool = True
) -> DataFrame:
    """One row per local day with contributions.

    A user is idle on a day when the last contribution on or before it is
    `idle_after_days` or more back: from d + idle_after_days until the next day
    n with a contribution. Adding 1 where such a stretch starts and taking 1
    where it ends turns the as-of lookup of every user on every day into one
    running sum over days.

    Rows are shuffled once, by user, and reduced to one row per user and day in place.
    Stored contributions have one row per user and UTC day, so a user's window is no longer
    than the calendar; the unpartitioned window sees one row per calendar day.
    """
    user = Window.partitionBy("user_id")
    in_time = user.orderBy("timestamp")
    local = contributions.select("user_id", "timestamp", local_day("timestamp", tz).alias("day"))
    first_of_day = (F.row_number().over(in_time) == 1) | ~F.col("day").eqNullSafe(F.lag("day").over(in_time))
    per_user_day = local.select("*", first_of_day.alias("first_of_day"), F.min("timestamp").over(user).alias("first_timestamp"))
    history = per_user_day.filter("first_of_day").select(
        "day",
        local_day("first_timestamp", tz).alias("first_day"),
        F.lead("day").over(in_time).alias("next_day"),
    )

    idle_from = F.date_add("day", idle_after_days)
    goes_idle = F.col("day").isNotNull() & (F.col("next_day").isNull() | (F.col("next_day") > idle_from))
    is_new = (F.col("day") == F.col("first_day")).cast("long")
    is_returning = (F.col("day") > F.col("first_day")).cast("long")
    none = F.lit(0).cast("long")

    def change(day, new, returning, present, idle):
        return F.struct(
            day.alias("day"),
            F.coalesce(new, none).alias("new_users"),
            F.coalesce(returning, none).alias("returning_users"),
            present.alias("total_daily_users"),
            idle.alias("idle_change"),
        )

    changes = F.array(
        change(F.col("day"), is_new, is_returning, none + 1, none),
        F.when(goes_idle, change(idle_from, none, none, none, none + 1)),
        F.when(goes_idle & F.col("next_day").isNotNull(), change(F.col("next_day"), none, none, none, none - 1)),
    )
    per_day = (
        history.select(F.explode(F.filter(changes, lambda c: c.isNotNull())).alias("c"))
        .select("c.*")
        .groupBy("day")
        .agg(*[F.sum(c).alias(c) for c in ("new_users", "returning_users", "total_daily_users", "idle_change")])
    )
    so_far = Window.orderBy(F.asc_nulls_first("day")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = per_day.select(
        "*",
        F.sum("new_users").over(so_far).alias("total_users_all_time"),
        F.sum("idle_change").over(so_far).alias("idle_users"),
    )
    result = running.filter("total_daily_users > 0").select(
        "day",
        "new_users",
        "returning_users",
        "total_daily_users",
        "total_users_all_time",
        "idle_users",
        (F.col("total_users_all_time") - F.col("idle_users")).alias("active_users"),
    )
    return result.orderBy(F.desc("day")) if ordered else result
