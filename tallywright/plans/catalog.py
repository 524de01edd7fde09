"""The reports by name over a store, and as temporary views for SQL users."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame

from tallywright.functions.clock import LOCAL_ZONE, local_today
from tallywright.plans.alerts import anniversary_totals_over, weekly_transactions_over
from tallywright.plans.cohorts import cohort_retention
from tallywright.plans.cumulative import cumulative_by_user, daily_cumulative
from tallywright.plans.idle import idle_users
from tallywright.plans.medians import medians
from tallywright.plans.new_returning import new_returning_daily
from tallywright.plans.periodic import periodic_stats
from tallywright.plans.segments import whales_minnows
from tallywright.sources.store import ContributionStore

# Each takes users, contributions, the report day (None: today) and the local zone.
REPORTS: dict[str, Callable[[DataFrame, DataFrame, date | None, str], DataFrame]] = {
    "periodic_stats": lambda u, c, day, tz: periodic_stats(c, as_of=day, tz=tz),
    "medians": lambda u, c, day, tz: medians(u, c, as_of=day),
    "cohort_retention": lambda u, c, day, tz: cohort_retention(u, c, tz=tz),
    "cumulative_by_user": lambda u, c, day, tz: cumulative_by_user(u, c),
    "idle_users": lambda u, c, day, tz: idle_users(u, c, as_of=day),
    "daily_cumulative": lambda u, c, day, tz: daily_cumulative(c, tz=tz),
    "new_returning_daily": lambda u, c, day, tz: new_returning_daily(c, tz=tz),
    "whales_minnows": lambda u, c, day, tz: whales_minnows(u, c, as_of=day),
    "anniversary_totals_over": lambda u, c, day, tz: anniversary_totals_over(u, c),
    "weekly_transactions_over": lambda u, c, day, tz: weekly_transactions_over(c),
}


def report(
    store: ContributionStore, name: str, *, as_of: date | None = None, tz: str = LOCAL_ZONE
) -> DataFrame:
    """A report over the store's tables, both as of its last commit."""
    now = store.snapshot()
    return REPORTS[name](now.users(), now.contributions(), as_of, tz)


def register_views(store: ContributionStore, *, as_of: date | None = None, tz: str = LOCAL_ZONE) -> None:
    """Makes both tables and every report available to `spark.sql` under their names.

    The views show the tables as they are now, and the same report day for all: `as_of`, or
    today in `tz` when they are registered. Register again after a load or on another day.
    """
    as_of = as_of or local_today(tz)
    now = store.snapshot()
    users, contributions = now.users(), now.contributions()
    users.createOrReplaceTempView("users")
    contributions.createOrReplaceTempView("contributions")
    for name, build in REPORTS.items():
        build(users, contributions, as_of, tz).createOrReplaceTempView(name)
