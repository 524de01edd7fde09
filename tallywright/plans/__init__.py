"""The reports, each a lazy DataFrame over `users` and `contributions`."""

from tallywright.plans.alerts import anniversary_totals_over, weekly_transactions_over
from tallywright.plans.cohorts import cohort_retention
from tallywright.plans.cumulative import cumulative_by_user, daily_cumulative
from tallywright.plans.idle import idle_users
from tallywright.plans.medians import medians
from tallywright.plans.new_returning import new_returning_daily
from tallywright.plans.periodic import daily_maxima, period_totals, periodic_stats
from tallywright.plans.segments import whales_minnows

__all__ = [
    "anniversary_totals_over",
    "cohort_retention",
    "cumulative_by_user",
    "daily_cumulative",
    "daily_maxima",
    "idle_users",
    "medians",
    "new_returning_daily",
    "period_totals",
    "periodic_stats",
    "weekly_transactions_over",
    "whales_minnows",
]
