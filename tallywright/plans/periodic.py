"""KPI report: nine metrics by nine periods, with the best day of each."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.amounts import count_ratio, exact_mean, exact_sum, round_half_up
from tallywright.functions.clock import LOCAL_ZONE, Period, local_today, reporting_periods
from tallywright.operators.rollups import daily_stats, user_days

SINGLE_DAYS = ("today", "yesterday")


def period_totals(
    contributions: DataFrame, *, as_of: date | None = None, tz: str = LOCAL_ZONE
) -> DataFrame:
    """One row per period: distinct users, sums, and means over the days with data."""
    per_user_day = user_days(contributions, tz)
    return _period_totals(per_user_day, daily_stats(per_user_day), reporting_periods(as_of or local_today(tz)))


def _period_totals(per_user_day: DataFrame, daily: DataFrame, periods: list[Period]) -> DataFrame:
    """Both branches read the same user-day shuffle.

    Distinct users per period come from one flag per period on one row per user,
    so overlapping periods neither multiply the rows nor need a distinct count.
    The whole-history sums are taken in that branch too: it then needs the same
    columns as the daily one and Spark reuses the exchange.
    """
    sums = [exact_sum(name).alias(name) for name in ("contribution", "fee")]
    flags = per_user_day.groupBy("user_id").agg(*[F.expr(f"max({p.holds('day')}) AS {p.name}") for p in periods], *sums)
    reach = flags.agg(*[F.expr(f"count_if({p.name}) AS {p.name}") for p in periods], *sums)

    def day(value: date | None) -> str:
        return "CAST(NULL AS DATE)" if value is None else f"DATE'{value}'"

    rows = [
        f"named_struct('position', {i}, 'period', '{p.name}', 'period_start', {day(p.start)}, "
        f"'period_end', {day(p.end)}, 'elapsed_to', {day(p.elapsed_to)}, 'users', {p.name}, "
        f"'all_contributions', {'contribution' if p.start is None else 'CAST(NULL AS DOUBLE)'}, "
        f"'all_fees', {'fee' if p.start is None else 'CAST(NULL AS DOUBLE)'})"
        for i, p in enumerate(periods)
    ]
    reach = reach.selectExpr(f"inline(array({', '.join(rows)}))")

    names = ", ".join(f"IF({p.holds('day')}, '{p.name}', NULL)" for p in periods)
    # At most one row per period: small enough to broadcast by construction.
    by_period = (
        daily.selectExpr("*", f"explode(array_compact(array({names}))) AS period")
        .groupBy("period")
        .agg(
            exact_sum("daily_contributions").alias("contributions"),
            exact_sum("daily_fees").alias("fees"),
            F.count(F.lit(1)).alias("days_with_data"),
            F.sum("daily_users").alias("sum_daily_users"),
            exact_mean("daily_contributions").alias("avg_daily_contributions"),
            exact_mean("daily_fees").alias("avg_daily_fees"),
            exact_mean("daily_arpu").alias("avg_daily_arpu"),
            F.min("day").alias("first_day"),
            F.max("day").alias("last_day"),
        )
    )
    return reach.join(F.broadcast(by_period), "period", "left").select(
        "position",
        "period",
        "period_start",
        "period_end",
        "elapsed_to",
        "users",
        F.coalesce("all_contributions", "contributions").alias("contributions"),
        F.coalesce("all_fees", "fees").alias("fees"),
        F.coalesce("days_with_data", F.lit(0)).alias("days_with_data"),
        count_ratio(F.col("sum_daily_users"), F.col("days_with_data")).alias("avg_daily_users"),
        "avg_daily_contributions",
        "avg_daily_fees",
        "avg_daily_arpu",
        "first_day",
        "last_day",
    )


def daily_maxima(contributions: DataFrame, *, tz: str = LOCAL_ZONE) -> DataFrame:
    """One row: the largest daily value of each statistic and its latest day."""
    return _daily_maxima(daily_stats(user_days(contributions, tz)))


def _daily_maxima(daily: DataFrame) -> DataFrame:
    names = ("users", "contributions", "fees", "arpu")
    tops = daily.agg(*[F.expr(f"max(struct(daily_{n} AS value, day)) AS {n}") for n in names])
    return tops.selectExpr(
        *[part for n in names for part in (f"{n}.value AS max_{n}_value", f"{n}.day AS max_{n}_date")]
    )


def _cents(value: str) -> str:
    return f"rint(({value}) * 100) / 100"


# Metric: its value on a single day, over a period, and the best day shown with it.
_METRICS = {
    "unique_users": ("day_users", "users", "users"),
    "daily_avg_users": ("day_users", "avg_daily_users", None),
    "contributions": (_cents("contributions"), _cents("contributions"), "contributions"),
    "daily_avg_contributions": (_cents("contributions"), _cents("avg_daily_contributions"), None),
    "fees": (_cents("fees"), _cents("fees"), "fees"),
    "daily_avg_fees": (_cents("fees"), _cents("avg_daily_fees"), None),
    "arpu": (_cents("arpu"), _cents("arpu"), "arpu"),
    "daily_avg_arpu": (_cents("arpu"), _cents("avg_daily_arpu"), None),
    "daily_average_user_arpu": (_cents("arpu"), _cents("arpu / elapsed_days"), None),
}


def periodic_stats(
    contributions: DataFrame, *, as_of: date | None = None, tz: str = LOCAL_ZONE
) -> DataFrame:
    """Nine metrics by nine periods, plus the best daily value and its day.

    Single days hold that day's statistic, NULL when it has no rows. Means run
    over days with data, not over calendar days. An empty period gives 0 for
    `unique_users` and NULL for every other metric.
    """
    per_user_day = user_days(contributions, tz)
    daily = daily_stats(per_user_day)
    periods = reporting_periods(as_of or local_today(tz))

    on_day = ", ".join(f"CAST({day} AS DOUBLE)" for day, _, _ in _METRICS.values())
    on_period = ", ".join(f"CAST({period} AS DOUBLE)" for _, period, _ in _METRICS.values())
    single = ", ".join(f"'{name}'" for name in SINGLE_DAYS)
    totals = (
        _period_totals(per_user_day, daily, periods)
        .withColumn("avg_daily_users", round_half_up(F.col("avg_daily_users"), 2))
        .selectExpr(
            "*",
            "IF(days_with_data > 0, users, NULL) AS day_users",
            "fees / nullif(users, 0) AS arpu",
            "datediff(coalesce(elapsed_to, last_day), coalesce(period_start, first_day)) + 1 AS elapsed_days",
        )
        .selectExpr("position", f"IF(period IN ({single}), array({on_day}), array({on_period})) AS metrics")
    )

    # Nine rows, one per period, turned into nine rows, one per metric.
    tops = _daily_maxima(daily)
    shown = [best for _, _, best in _METRICS.values()]
    values = [
        "NULL" if best is None else f"max_{best}_value" if best == "users" else _cents(f"max_{best}_value")
        for best in shown
    ]
    days = ["CAST(NULL AS DATE)" if best is None else f"max_{best}_date" for best in shown]
    best = tops.selectExpr(
        f"array({', '.join(f'CAST({v} AS DOUBLE)' for v in values)}) AS best_values",
        f"array({', '.join(days)}) AS best_days",
    )
    names = ", ".join(f"'{metric}'" for metric in _METRICS)
    return (
        totals.agg(F.expr("array_sort(collect_list(struct(position, metrics))).metrics AS cells"))
        .crossJoin(F.broadcast(best))
        .selectExpr("*", f"posexplode(array({names})) AS (m, metric)")
        .selectExpr(
            "metric",
            *[f"cells[{i}][m] AS {p.name}" for i, p in enumerate(periods)],
            "best_values[m] AS max_users_value",
            "best_days[m] AS max_users_date",
        )
    )
