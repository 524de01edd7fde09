"""User ids under a collation: spellings that it holds equal are one user everywhere."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from test_landing import HEADER, landing  # noqa: F401

from tallywright.functions.collation import CASE_AND_ACCENT_INSENSITIVE, collated, is_collated, spelled
from tallywright.operators.first_wins import first_wins, not_stored
from tallywright.operators.user_dimension import backfill_dates, new_users
from tallywright.plans.catalog import REPORTS, report
from tallywright.sources.store import ContributionStore

COLUMNS = ["timestamp", "user_id", "contribution", "fee", "transaction_count"]


@pytest.fixture
def store(spark, tmp_path):
    return ContributionStore(spark, str(tmp_path / "store"), id_collation=CASE_AND_ACCENT_INSENSITIVE)


def spellings(df, column="user_id"):
    return sorted(r[0] for r in df.select(spelled(column)).collect())


def test_columns_keep_their_spelling(spark):
    df = spark.createDataFrame([("U-a",), ("u-A ",), (None,)], "user_id string")
    found = collated(df, CASE_AND_ACCENT_INSENSITIVE, "user_id")
    assert is_collated(found, "user_id") and not is_collated(df, "user_id") and collated(df, None, "user_id") is df
    assert sorted(str(r[0]) for r in found.collect()) == ["None", "U-a", "u-A "]
    assert found.distinct().count() == 2 and found.groupBy("user_id").count().count() == 2


def test_first_wins_and_anti_join(contributions):
    rows = collated(
        contributions(("2024-06-01 10:00", "Ünal", 1.0), ("2024-06-01 09:00", "unal ", 2.0), ("2024-06-02 09:00", "UNAL", 3.0)),
        CASE_AND_ACCENT_INSENSITIVE, "user_id",
    )
    kept = first_wins(rows, ["timestamp"])
    assert sorted(r["contribution"] for r in kept.collect()) == [2.0, 3.0]
    assert [r["contribution"] for r in not_stored(rows, rows.filter("contribution = 1")).collect()] == [3.0]


def test_new_users_take_their_first_spelling(spark, contributions, users):
    rows = collated(contributions(("2024-06-02 10:00", "U-A"), ("2024-06-01 10:00", "u-a"), ("2024-06-03 10:00", "u-B")), "UNICODE_CI", "user_id")
    known = collated(users(("U-b", None)), "UNICODE_CI", "id")
    assert spellings(new_users(rows, known, ["timestamp"]), "id") == ["u-a"]
    assert spellings(new_users(rows, collated(users(), "UNICODE_CI", "id"), ["timestamp"]), "id") == ["u-B", "u-a"]
    dates = backfill_dates(known, rows).first()
    assert (dates["date_joined"], dates["last_contrib"]) == (date(2024, 6, 3), datetime(2024, 6, 3))


def test_loads_hold_spellings_of_one_user_together(store, landing):  # noqa: F811
    landing("2025-01-15", "a_20250115_190002.csv", HEADER + "1,José,10,1,1\n2,JOSE,20,2,1\n3,ann,5,1,1\n")
    store.load_new(landing.root)
    landing("2025-01-15", "b_20250115_200002.csv", HEADER + "1,jose,30,1,1\n")
    landing("2025-01-16", "b_20250116_190002.csv", HEADER + "1,JOSÉ ,40,1,1\n2,Ann,6,1,1\n")
    store.load_new(landing.root)
    store.compact()
    assert spellings(store.contributions()) == ["Ann", "JOSÉ ", "José", "ann"]
    assert {r["id"]: (r["date_joined"], r["last_contrib"]) for r in store.users().collect()} == {
        "José": (date(2025, 1, 15), datetime(2025, 1, 16)), "ann": (date(2025, 1, 15), datetime(2025, 1, 16))
    }
    totals = report(store, "cumulative_by_user")
    assert {r["id"]: float(r["total_contributions"]) for r in totals.collect()} == {"José": 50.0, "ann": 11.0}
    # A store without a collation sees four users in the same files.
    plain = ContributionStore(store.spark, f"{store.root}-plain")
    plain.load_landing(landing.root)
    assert plain.users().count() == 6


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_every_report_takes_collated_ids(spark, users, contributions, name):
    """Reports over mixed spellings equal those over ids in lower case."""
    rows = contributions(
        ("2024-06-01 10:00", "U-a", 5.0, 0.5, 200), ("2024-06-03 10:00", "u-A", 7.0, 0.7, 300),
        ("2024-06-09 10:00", "u-b", 9000.0, 0.1, 400), ("2024-06-10 10:00", "U-B", 1.0, 0.1, 1), ("2024-05-01 10:00", "u-C", 3.0, 0.3, 2),
    )
    people = users(("u-a", "2024-05-31"), ("U-b", "2024-06-01"), ("U-C", "2024-05-01"))
    shown = REPORTS[name](collated(people, "UNICODE_CI", "id"), collated(rows, "UNICODE_CI", "user_id"), date(2024, 6, 10), "UTC")
    wanted = REPORTS[name](people.withColumn("id", F.lower("id")), rows.withColumn("user_id", F.lower("user_id")), date(2024, 6, 10), "UTC")
    lowered = lambda df: sorted([str(v).lower() if c in ("id", "user_id") else str(v) for c, v in r.asDict().items()] for r in df.collect())
    assert lowered(shown) == lowered(wanted) and lowered(wanted)
