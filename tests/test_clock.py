from datetime import UTC, date, datetime

import pytest
from tallywright.functions.clock import (
    financial_year_start,
    local_day,
    local_month,
    local_today,
    reporting_periods,
    session_today,
    utc_day,
)


@pytest.mark.parametrize(
    ("utc", "local", "utc_expected"),
    [
        ("2025-06-30 11:59:59", date(2025, 6, 30), date(2025, 6, 30)),
        ("2025-06-30 12:00:00", date(2025, 7, 1), date(2025, 6, 30)),
        # Summer time: 13 hours ahead.
        ("2025-01-15 10:59:59", date(2025, 1, 15), date(2025, 1, 15)),
        ("2025-01-15 11:00:00", date(2025, 1, 16), date(2025, 1, 15)),
        # The clock goes back on 6 April 2025 and forward on 28 September 2025.
        ("2025-04-05 11:00:00", date(2025, 4, 6), date(2025, 4, 5)),
        ("2025-04-06 11:59:59", date(2025, 4, 6), date(2025, 4, 6)),
        ("2025-09-27 12:00:00", date(2025, 9, 28), date(2025, 9, 27)),
        ("2025-09-28 11:00:00", date(2025, 9, 29), date(2025, 9, 28)),
    ],
)
def test_days(spark, utc, local, utc_expected):
    frame = spark.createDataFrame([(datetime.fromisoformat(utc),)], "t timestamp_ntz")
    assert frame.select(local_day("t"), utc_day("t")).first() == (local, utc_expected)


def test_days_do_not_follow_the_session_zone(spark):
    frame = spark.createDataFrame([(datetime(2025, 6, 30, 12),)], "t timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = frame.select(local_day("t"), local_month("t"), utc_day("t")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert row == (date(2025, 7, 1), date(2025, 7, 1), date(2025, 6, 30))


@pytest.mark.parametrize(
    ("day", "start"),
    [
        (date(2025, 6, 30), date(2024, 7, 1)),
        (date(2025, 7, 1), date(2025, 7, 1)),
        (date(2025, 1, 1), date(2024, 7, 1)),
        (date(2025, 12, 31), date(2025, 7, 1)),
    ],
)
def test_financial_year(day, start):
    assert financial_year_start(day) == start


@pytest.mark.parametrize(
    ("today", "expected"),
    [
        (
            date(2025, 3, 31),
            {
                "today": (date(2025, 3, 31), date(2025, 3, 31)),
                "yesterday": (date(2025, 3, 30), date(2025, 3, 30)),
                "this_week": (date(2025, 3, 31), date(2025, 4, 6)),
                "last_week": (date(2025, 3, 24), date(2025, 3, 30)),
                "this_month": (date(2025, 3, 1), date(2025, 3, 31)),
                "last_month": (date(2025, 2, 1), date(2025, 2, 28)),
                "current_fy": (date(2024, 7, 1), date(2025, 6, 30)),
                "last_fy": (date(2023, 7, 1), date(2024, 6, 30)),
            },
        ),
        (
            date(2024, 7, 7),
            {
                "this_week": (date(2024, 7, 1), date(2024, 7, 7)),
                "last_week": (date(2024, 6, 24), date(2024, 6, 30)),
                "last_month": (date(2024, 6, 1), date(2024, 6, 30)),
                "current_fy": (date(2024, 7, 1), date(2025, 6, 30)),
            },
        ),
    ],
)
def test_periods(today, expected):
    periods = {p.name: p for p in reporting_periods(today)}
    for name, bounds in expected.items():
        assert (periods[name].start, periods[name].end) == bounds, name
    assert periods["all_time"].start is None


def test_today_defaults_to_the_clock(spark):
    now = datetime.now(UTC).date()
    today = spark.range(1).select(session_today()).first()[0]
    assert abs((today - now).days) <= 1
    assert 0 <= (local_today() - today).days <= 1
