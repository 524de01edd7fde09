import random
import re
from collections import defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal
from zoneinfo import ZoneInfo

import pytest
from conftest import dicts
from pyspark.sql import functions as F

from tallywright import plans

AS_OF = date(2025, 6, 30)
UTC, LOCAL = ZoneInfo("UTC"), ZoneInfo("Pacific/Auckland")


def to_local(ts):
    return ts.replace(tzinfo=UTC).astimezone(LOCAL).date()


def random_history(seed, users=12, rows=150, span_days=90):
    rng = random.Random(seed)
    start = datetime(2025, 3, 1)
    return [
        (
            start + timedelta(seconds=rng.randrange(span_days * 86_400)),
            f"u{rng.randrange(users)}",
            rng.choice([None, round(rng.uniform(0, 500), 2)]),
            round(rng.uniform(0, 20), 2),
            rng.choice([None, rng.randrange(200)]),
        )
        for _ in range(rows)
    ]


# Running totals


def test_daily_cumulative(contributions):
    rows = dicts(
        plans.daily_cumulative(
            contributions(
                ("2025-06-29 11:00:00", "a", 10.0, 1.0, 2),
                ("2025-06-29 13:00:00", "a", 5.5, None, None),
                ("2025-06-30 10:00:00", "b", None, 0.25, 4),
                ("2025-07-05 19:00:00", "b", 1.0, 0.0, 1),
            )
        )
    )
    assert [r["date"] for r in rows] == [date(2025, 6, 29), date(2025, 6, 30), date(2025, 7, 6)]
    assert [r["daily_contributions"] for r in rows] == [Decimal("10.00"), Decimal("5.50"), Decimal("1.00")]
    assert [r["daily_fees"] for r in rows] == [Decimal("1.00"), Decimal("0.25"), Decimal("0.00")]
    assert [r["daily_transactions"] for r in rows] == [2, 4, 1]
    assert [r["cumulative_contributions"] for r in rows] == [Decimal("10.00"), Decimal("15.50"), Decimal("16.50")]
    assert rows[-1]["adj_cumulative_contributions"] == Decimal("1889.11")
    assert rows[-1]["adj_cumulative_fees"] == Decimal("188.51")
    assert rows[-1]["adj_cumulative_transactions"] == 3944


def test_daily_cumulative_ends_at_the_total(contributions):
    history = random_history(1)
    last = dicts(plans.daily_cumulative(contributions(*history)))[-1]
    assert float(last["cumulative_contributions"]) == pytest.approx(sum(r[2] or 0 for r in history))
    assert last["cumulative_transactions"] == sum(r[4] or 0 for r in history)


def test_rows_without_a_time_form_the_first_day(contributions):
    rows = dicts(plans.daily_cumulative(contributions((None, "a", 1.0), ("2025-06-01 00:00:00", "a", 2.0))))
    assert [r["date"] for r in rows] == [None, date(2025, 6, 1)]
    assert rows[1]["cumulative_contributions"] == Decimal("3.00")


def test_cumulative_by_user(users, contributions):
    rows = dicts(
        plans.cumulative_by_user(
            users(("a", "2025-01-01"), ("b", "2025-01-01", None, "X"), ("silent", "2025-01-01")),
            contributions(
                ("2025-06-01 23:00:00", "a", 10.0, 1.0, None),
                ("2025-06-04 01:00:00", "a", 20.0, 1.0, None),
                ("2025-06-04 01:00:00", "b", 5.0, 9.0, 7),
                ("2025-06-04 01:00:00", "stranger", 5.0, 9.0, 7),
            ),
        )
    )
    assert [r["id"] for r in rows] == ["b", "a"]
    assert rows[0]["full_name"] is None and rows[0]["total_transactions"] == 7
    assert rows[1]["total_transactions"] is None and rows[1]["num_contributions"] == 2
    assert rows[1]["lifespan_days"] == 3 and rows[1]["total_contributions"] == Decimal("30.00")


# Idle, new and returning users


def test_idle_is_strictly_more_than_fourteen_days(users, contributions):
    rows = dicts(
        plans.idle_users(
            users(("fifteen", "2025-01-01"), ("fourteen", "2025-01-01"), ("silent", "2025-01-01"), ("old", None)),
            contributions(
                ("2025-06-15 23:59:59", "fifteen"), ("2025-06-16 00:00:00", "fourteen"), ("2025-01-01 00:00:00", "old")
            ),
            as_of=AS_OF,
        )
    )
    assert [(r["id"], r["days_since_last_contribution"]) for r in rows] == [("old", 180), ("fifteen", 15)]


def brute_new_returning(history):
    days = defaultdict(set)
    first = {}
    for ts, user, *_ in history:
        days[user].add(to_local(ts))
        first[user] = min(first.get(user, ts), ts)
    first = {u: to_local(ts) for u, ts in first.items()}
    result = {}
    for day in {d for v in days.values() for d in v}:
        present = {u for u in days if day in days[u]}
        known = sum(f <= day for f in first.values())
        idle = sum(
            1 for v in days.values() if (seen := [d for d in v if d <= day]) and max(seen) <= day - timedelta(14)
        )
        new = sum(first[u] == day for u in present)
        result[day] = (new, len(present) - new, len(present), known, idle, known - idle)
    return result


@pytest.mark.parametrize("seed", range(3))
def test_new_returning_matches_brute_force(contributions, seed):
    history = random_history(seed)
    rows = plans.new_returning_daily(contributions(*history)).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == brute_new_returning(history)
    assert [r[0] for r in rows] == sorted((r[0] for r in rows), reverse=True)
    for r in rows:
        assert r["new_users"] + r["returning_users"] == r["total_daily_users"]
        assert r["active_users"] + r["idle_users"] == r["total_users_all_time"]


def test_idle_after_fourteen_days_in_the_daily_series(contributions):
    rows = plans.new_returning_daily(
        contributions(
            ("2025-06-01 00:00:00", "a"),
            ("2025-06-14 00:00:00", "b"),
            ("2025-06-15 00:00:00", "b"),
            ("2025-06-16 00:00:00", "a"),
        ),
        tz="UTC",
    ).collect()
    assert {r["day"].day: r["idle_users"] for r in rows} == {1: 0, 14: 0, 15: 1, 16: 0}


def test_rows_without_a_time_count_as_present_only(contributions):
    rows = plans.new_returning_daily(contributions((None, "a"), (None, "b"), ("2025-06-01 00:00:00", "a"))).collect()
    assert [tuple(r) for r in rows] == [(date(2025, 6, 1), 1, 0, 1, 1, 0, 1), (None, 0, 0, 2, 0, 0, 0)]


# Cohorts


def test_cohorts_mix_utc_joining_and_local_activity(users, contributions):
    rows = plans.cohort_retention(
        users(("edge", "2025-05-31"), ("mid", "2025-05-10"), ("silent", "2025-05-10"), ("unknown", None)),
        contributions(
            ("2025-05-31 20:00:00", "edge"),
            ("2025-05-10 20:00:00", "mid"),
            ("2025-05-12 20:00:00", "mid"),
            ("2025-07-10 20:00:00", "mid"),
            ("2025-04-10 20:00:00", "mid"),
            ("2025-04-10 20:00:00", "unknown"),
        ),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("2025-05", 0, 1, 3, Decimal("33.3")),
        ("2025-05", 1, 1, 3, Decimal("33.3")),
        ("2025-05", 2, 1, 3, Decimal("33.3")),
    ]


# Medians and classes


def test_medians(users, contributions):
    members = users(
        ("a", "2025-06-20"),
        ("b", "2025-06-10"),
        ("joined_today", "2025-06-30"),
        ("undated", None),
        ("inactive", "2025-01-01"),
        ("silent", "2025-01-01"),
    )
    rows = contributions(
        ("2025-06-29 00:00:00", "a", 100.0, 10.0, 1),
        ("2025-06-23 00:00:00", "b", 400.0, 20.0, 1),
        ("2025-06-30 00:00:00", "joined_today", 50.0, 5.0, 1),
        ("2025-06-30 00:00:00", "undated", 0.0, 5.0, 1),
        ("2025-06-22 23:59:59", "inactive", 9999.0, 999.0, 1),
    )
    row = plans.medians(members, rows, as_of=AS_OF).first().asDict()
    assert row["median_daily_contribution"] == 5.0
    assert row["median_daily_fee"] == 0.5
    assert row["median_of_per_user_fee_percentages"] == (0.05 + 0.1) / 2
    assert row["percentage_of_medians"] == 0.1


def test_medians_without_active_users(users, contributions):
    row = plans.medians(users(("a", "2025-01-01")), contributions(("2025-01-01 00:00:00", "a")), as_of=AS_OF).first()
    assert list(row) == [None] * 4


def test_ratio_of_medians_needs_a_positive_first(users, contributions):
    row = plans.medians(
        users(("a", "2025-06-30")), contributions(("2025-06-30 00:00:00", "a", 5.0, 1.0, 1)), as_of=AS_OF
    ).first()
    assert list(row) == [0.0, 0.0, 0.2, None]


def test_classes_of_users(users, contributions):
    members = [("whale", "2025-06-20"), ("future", "2025-07-10"), ("away", "2025-06-20"), ("silent", "2025-06-20")]
    members += [(f"d{i}", "2025-06-20") for i in range(8)]
    rows = [("2025-06-23 00:00:00", "whale", 10.0, 1000.0, 1), ("2025-06-22 00:00:00", "away", 10.0, 1000.0, 1)]
    rows += [("2025-06-30 00:00:00", f"d{i}", 500.0, 100.0, 1) for i in range(8)]
    rows += [("2025-06-30 00:00:00", "future", 500.0, 100.0, 1)]
    result = {r["user_id"]: r for r in plans.whales_minnows(users(*members), contributions(*rows), as_of=AS_OF).collect()}
    assert len(result) == 12
    assert result["whale"]["user_class_by_fee"] == "whale"
    assert result["whale"]["user_class_by_contribution"] == "minnow"
    assert result["away"]["user_class_by_fee"] == "inactive" and result["away"]["days_since_last_contribution"] == 8
    assert result["silent"]["user_class_by_fee"] == "inactive" and result["silent"]["total_fees"] == 0.0
    assert result["silent"]["days_since_last_contribution"] is None
    assert result["future"]["monthly_average_fee"] == 0.0
    assert result["d0"]["user_class_by_fee"] == "dolphin"
    assert result["d0"]["daily_average_fee"] == 10.0 and result["d0"]["monthly_average_fee"] == 304.4


def test_spread_is_the_population_deviation(users, contributions):
    # Rates 0 and 3: mean 1.5, population deviation 1.5 (sample: 2.12). 3 > 3 does not hold, so no whale.
    members = users(("a", "2025-06-29"), ("b", "2025-06-29"))
    rows = contributions(("2025-06-30 00:00:00", "a", 0.0, 0.0, 1), ("2025-06-30 00:00:00", "b", 3.0, 3.0, 1))
    classes = [r["user_class_by_fee"] for r in plans.whales_minnows(members, rows, as_of=AS_OF).collect()]
    assert classes == ["dolphin", "dolphin"]


# Alerts


def test_anniversary_years(users, contributions):
    members = users(("a", "2023-06-01"), ("leap", "2024-02-29"), ("undated", None), ("nameless", "2024-01-01", None, "X"))
    rows = contributions(
        ("2023-06-01 10:00:00", "a", 5000.0),
        ("2024-05-31 10:00:00", "a", 3000.01),  # day 365: still the first year
        ("2024-06-01 10:00:00", "a", 8000.0),  # day 366: second year, not above the threshold
        ("2025-03-01 10:00:00", "leap", 9000.0),
        ("2024-03-01 10:00:00", "undated", 9000.0),
        ("2023-12-31 10:00:00", "nameless", 9000.0),  # before joining
    )
    result = [tuple(r) for r in plans.anniversary_totals_over(members, rows).collect()]
    assert result == [
        ("a", "A B", date(2023, 6, 1), date(2024, 6, 1), 8000.01),
        ("leap", "A B", date(2025, 2, 28), date(2026, 2, 28), 9000.0),
        ("nameless", None, date(2023, 1, 1), date(2024, 1, 1), 9000.0),
    ]


def test_six_days_back_go_by_the_clock(contributions):
    rows = contributions(
        ("2025-06-01 09:00:00", "a", 1.0, 1.0, 200),
        ("2025-06-07 09:00:00", "a", 1.0, 1.0, 200),
        ("2025-06-01 08:59:59", "b", 1.0, 1.0, 200),
        ("2025-06-07 09:00:00", "b", 1.0, 1.0, 200),
        (None, "c", 1.0, 1.0, 999),
        ("2025-06-07 09:00:00", "d", 1.0, 1.0, 350),
        ("2025-06-08 09:00:00", "e", 1.0, 1.0, None),
    )
    result = [tuple(r) for r in plans.weekly_transactions_over(rows).collect()]
    assert result == [("a", date(2025, 6, 7), 400)]


@pytest.mark.parametrize(("seed", "stretch"), [(1, 56), (2, 7), (3, 1), (4, 3)])
def test_weekly_matches_the_self_join(contributions, seed, stretch):
    history = random_history(seed, users=3, rows=120, span_days=60)
    history += history[:10]  # repeated timestamps multiply, as in a self-join
    sums = defaultdict(lambda: None)
    for ts, user, _, _, _ in history:
        for other, name, _, _, count in history:
            if name == user and ts - timedelta(6) <= other <= ts and count is not None:
                sums[user, ts] = (sums[user, ts] or 0) + count
    expected = sorted((u, ts.date(), n) for (u, ts), n in sums.items() if n is not None and n > 350)
    result = plans.weekly_transactions_over(contributions(*history), stretch_days=stretch)
    assert sorted(tuple(r) for r in result.collect()) == expected


# KPI report


def report(contributions, **options):
    return {r["metric"]: r for r in dicts(plans.periodic_stats(contributions, **options))}


def test_periodic_stats_by_hand(contributions):
    # Monday 30 June 2025: the last day of the financial year.
    rows = report(
        contributions(
            ("2025-06-29 19:00:00", "a", 10.0, 1.0, 1),  # local 30 June
            ("2025-06-29 20:00:00", "b", 20.0, 2.0, 1),
            ("2025-06-27 19:00:00", "a", 5.0, 0.5, 1),  # local 28 June, last week
            ("2025-06-25 19:00:00", "a", 7.0, 0.7, 1),  # local 26 June, last week
            ("2024-06-29 19:00:00", "c", 100.0, 9.0, 1),  # local 30 June 2024, last financial year
        ),
        as_of=AS_OF,
    )
    users = rows["unique_users"]
    assert [users[c] for c in ("today", "yesterday", "this_week", "last_week", "this_month", "last_month")] == [
        2, None, 2, 1, 2, 0,
    ]
    assert [users[c] for c in ("current_fy", "last_fy", "all_time", "max_users_value")] == [2, 1, 3, 2]
    assert users["max_users_date"] == date(2025, 6, 30)

    average = rows["daily_avg_users"]
    assert (average["today"], average["this_month"], average["last_month"]) == (2, 1.33, None)
    assert average["max_users_value"] is None and average["max_users_date"] is None

    amounts = rows["contributions"]
    assert (amounts["today"], amounts["last_week"], amounts["this_month"]) == (30, 12, 42)
    assert (amounts["last_month"], amounts["all_time"]) == (None, 142)
    assert (amounts["max_users_value"], amounts["max_users_date"]) == (100, date(2024, 6, 30))
    assert rows["daily_avg_contributions"]["last_week"] == 6
    assert rows["daily_avg_contributions"]["all_time"] == 35.5

    assert rows["fees"]["this_month"] == 4.2 and rows["daily_avg_fees"]["this_month"] == 1.4
    assert rows["arpu"]["this_month"] == 2.1 and rows["arpu"]["today"] == 1.5
    assert rows["daily_avg_arpu"]["this_month"] == 0.9

    spread = rows["daily_average_user_arpu"]
    assert spread["today"] == 1.5
    assert spread["this_week"] == 1.5  # Monday: one day has passed
    assert spread["last_week"] == 0.17  # 1.2 / 1 / 7
    assert spread["this_month"] == 0.07  # 4.2 / 2 / 30
    assert spread["all_time"] == 0.01  # 13.2 / 3 / 366


def test_periodic_stats_order_and_ties(contributions):
    rows = contributions(("2025-06-01 00:00:00", "a", 5.0), ("2025-06-03 00:00:00", "a", 5.0))
    result = plans.periodic_stats(rows, as_of=AS_OF)
    assert [r["metric"] for r in result.collect()] == [
        "unique_users",
        "daily_avg_users",
        "contributions",
        "daily_avg_contributions",
        "fees",
        "daily_avg_fees",
        "arpu",
        "daily_avg_arpu",
        "daily_average_user_arpu",
    ]
    assert result.filter("metric = 'contributions'").first()["max_users_date"] == date(2025, 6, 3)


def test_periodic_stats_on_nothing(contributions):
    rows = report(contributions(("2025-06-01 00:00:00", "a")).filter(F.lit(False)), as_of=AS_OF)
    assert len(rows) == 9
    assert rows["unique_users"]["this_week"] == 0 and rows["unique_users"]["all_time"] == 0
    assert rows["unique_users"]["today"] is None and rows["unique_users"]["max_users_value"] is None
    assert all(v is None for k, v in rows["arpu"].items() if k != "metric")


def test_rows_without_a_time_count_for_all_time_only(contributions):
    rows = report(contributions((None, "a", 5.0, 1.0, 1), ("2025-06-29 19:00:00", "b", 7.0, 1.0, 1)), as_of=AS_OF)
    assert (rows["unique_users"]["this_week"], rows["unique_users"]["all_time"]) == (1, 2)
    assert (rows["contributions"]["this_week"], rows["contributions"]["all_time"]) == (7, 12)
    assert rows["daily_avg_contributions"]["all_time"] == 6


def test_contributions_are_read_once_for_all_periods(contributions):
    result = plans.periodic_stats(contributions(*random_history(5)), as_of=AS_OF)
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Scan ") == 1
    assert "ReusedExchange" in plan


def exchanges(result, *columns):
    """Shuffles by exactly these columns in the plan that ran."""
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    found = [re.sub(r"#\d+L?", "", c) for c in re.findall(r"(?<!Reused)Exchange hashpartitioning\((.*?), \d+\)", plan)]
    return [c for c in found if set(columns) <= set(c.split(", "))]


def test_user_level_reports_shuffle_contributions_once(contributions, users, spark):
    rows = contributions(*random_history(6))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        members = users(("a", "2020-01-01"), ("b", "2021-01-01"))
        yearly = plans.anniversary_totals_over(members, rows, threshold=0, ordered=False)
        assert exchanges(yearly, "user_id") == ["user_id"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert exchanges(plans.new_returning_daily(rows, ordered=False), "user_id") == ["user_id"]
    assert set(exchanges(plans.periodic_stats(rows, as_of=AS_OF), "user_id")) == {"user_id"}


@pytest.mark.parametrize(("active", "size", "share"), [(4, 21, "19.0"), (13, 107, "12.1"), (1, 8, "12.5"), (1, 3, "33.3"), (2, 3, "66.7")])
def test_retention_is_rounded_once(contributions, users, active, size, share):
    members = users(*[(f"u{i}", "2024-01-10") for i in range(size)])
    rows = contributions(*[("2024-02-10 00:00", f"u{i}") for i in range(active)])
    assert [str(r["pct_retained"]) for r in plans.cohort_retention(members, rows).collect()] == [share]
