"""Days, months and reporting periods.

Two day definitions live side by side: the UTC day of a stored timestamp and
the local day in a reporting time zone. Every operator says which one it uses.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from typing import NamedTuple
from zoneinfo import ZoneInfo

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LOCAL_ZONE = "Pacific/Auckland"
FINANCIAL_YEAR_FIRST_MONTH = 7
UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Etc/GMT", "Z", "+00:00"}


def utc_day(timestamp: Column | str) -> Column:
    return F.to_date(timestamp)


def _session_clock_is_utc() -> bool:
    session = SparkSession.getActiveSession()
    return session is not None and session.conf.get("spark.sql.session.timeZone") in UTC_NAMES


def local_day(timestamp: Column | str, tz: str = LOCAL_ZONE) -> Column:
    """Day on the wall clock of `tz` of a zone-less UTC timestamp.

    Under a UTC session a zone-less timestamp and an instant hold the same
    number, which allows the conversion that resolves the zone once per plan;
    the general one resolves it for every row.
    """
    ts = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    if _session_clock_is_utc():
        return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), tz))
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), ts))


def local_month(timestamp: Column | str, tz: str = LOCAL_ZONE) -> Column:
    """First day of the local calendar month."""
    return F.trunc(local_day(timestamp, tz), "MM")


def session_today(as_of: date | None = None) -> Column:
    """`as_of`, or the session's current day."""
    return F.lit(as_of) if as_of is not None else F.current_date()


def local_today(tz: str = LOCAL_ZONE) -> date:
    """The current day in `tz`."""
    return datetime.now(ZoneInfo(tz)).date()


class Period(NamedTuple):
    """A reporting period; without bounds it is the whole history.

    `elapsed_to` is the last day counted when a total is spread over days: today
    for a running period, the end for a closed one.
    """

    name: str
    start: date | None = None
    end: date | None = None
    elapsed_to: date | None = None

    def holds(self, day: str) -> str:
        """SQL condition on a day column."""
        return "true" if self.start is None else f"{day} BETWEEN DATE'{self.start}' AND DATE'{self.end}'"


def month_start(day: date, months: int = 0) -> date:
    """First day of the month of `day`, moved by `months`."""
    count = day.year * 12 + day.month - 1 + months
    return date(count // 12, count % 12 + 1, 1)


def financial_year_start(day: date) -> date:
    """1 July on or before `day`."""
    return month_start(day, -((day.month - FINANCIAL_YEAR_FIRST_MONTH) % 12))


def reporting_periods(today: date) -> list[Period]:
    """The nine periods of the KPI report, relative to `today`."""
    day, seven = timedelta(1), timedelta(7)
    week = today - day * today.weekday()
    month = month_start(today)
    year = financial_year_start(today)

    def running(name: str, start: date, following: date) -> Period:
        return Period(name, start, following - day, today)

    def closed(name: str, start: date, following: date) -> Period:
        return Period(name, start, following - day, following - day)

    return [
        closed("today", today, today + day),
        closed("yesterday", today - day, today),
        running("this_week", week, week + seven),
        closed("last_week", week - seven, week),
        running("this_month", month, month_start(month, 1)),
        closed("last_month", month_start(month, -1), month),
        running("current_fy", year, month_start(year, 12)),
        closed("last_fy", month_start(year, -12), year),
        Period("all_time"),
    ]
