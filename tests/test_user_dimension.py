from datetime import date, datetime

from pyspark.sql import functions as F

from tallywright.operators.first_wins import first_wins, not_stored
from tallywright.operators.user_dimension import apply_inserted_dates, backfill_dates, upsert_users


def by_id(users):
    return {r["id"]: (r["date_joined"], r["last_contrib"]) for r in users.collect()}


def test_first_row_of_a_day_wins(contributions):
    rows = contributions(
        ("2025-06-03 09:00:00", "a", 2.0),
        ("2025-06-03 08:00:00", "a", 1.0),
        ("2025-06-04 00:00:00", "a", 3.0),
        ("2025-06-03 23:59:59", "b", 4.0),
    )
    kept = first_wins(rows, ["timestamp"])
    assert sorted(r["contribution"] for r in kept.collect()) == [1.0, 3.0, 4.0]


def test_one_key_may_hold_most_rows(spark):
    rows = spark.range(50_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("user_id"),
        F.lit(date(2025, 1, 1)).alias("contrib_date"),
        F.col("id"),
    )
    kept = first_wins(rows, ["id"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[1]
    assert kept.count() == 16_668
    assert kept.filter("user_id = 'hot'").first()["id"] == 1


def test_stored_rows_win_over_new_ones(contributions):
    stored = contributions(("2025-06-03 09:00:00", "a"))
    rows = contributions(("2025-06-03 01:00:00", "a"), ("2025-06-04 01:00:00", "a"), ("2025-06-03 01:00:00", "b"))
    left = not_stored(rows, stored)
    assert sorted((r["user_id"], r["contrib_date"].day) for r in left.collect()) == [("a", 4), ("b", 3)]


def test_upsert_adds_each_missing_user_once(users, contributions):
    known = users(("a", "2025-01-01"))
    rows = contributions(("2025-06-03 01:00:00", "a"), ("2025-06-03 01:00:00", "b"), ("2025-06-04 01:00:00", "b"))
    after = upsert_users(rows, known)
    assert by_id(after) == {"a": (date(2025, 1, 1), None), "b": (None, None)}
    assert after.schema.names == known.schema.names


def test_inserted_rows_only_widen_the_dates(users, contributions):
    known = users(
        ("a", "2025-06-10", "A", "B", "2025-06-20 00:00:00"), ("b", None), ("c", "2025-01-01", "A", "B", None)
    )
    inserted = contributions(
        ("2025-06-12 10:00:00", "a"),
        ("2025-06-25 10:00:00", "a"),
        ("2025-06-05 10:00:00", "b"),
        ("2025-06-07 10:00:00", "b"),
    )
    assert by_id(apply_inserted_dates(known, inserted)) == {
        "a": (date(2025, 6, 10), datetime(2025, 6, 25)),
        "b": (date(2025, 6, 5), datetime(2025, 6, 7)),
        "c": (date(2025, 1, 1), None),
    }


def test_backfill_overwrites_both_dates(users, contributions):
    known = users(
        ("a", "2020-01-01", "A", "B", "2026-01-01 00:00:00"),
        ("b", "2020-01-01", "A", "B", "2026-01-01 00:00:00"),
        ("c", "2020-01-01", "A", "B", "2026-01-01 00:00:00"),
    )
    history = contributions(("2025-06-12 10:00:00", "a"), ("2025-06-25 10:00:00", "a"), (None, "c"))
    assert by_id(backfill_dates(known, history)) == {
        "a": (date(2025, 6, 12), datetime(2025, 6, 25)),
        "b": (date(2020, 1, 1), datetime(2026, 1, 1)),
        "c": (None, None),
    }


def test_batches_of_inserts_end_where_the_backfill_does(users, contributions):
    batches = [
        contributions(("2025-06-12 10:00:00", "a"), ("2025-06-13 10:00:00", "b")),
        contributions(("2025-06-01 10:00:00", "a"), ("2025-07-13 10:00:00", "b")),
        contributions(("2025-06-20 10:00:00", "a"), ("2025-06-14 10:00:00", "c")),
    ]
    grown = users(("z", None)).filter("id <> 'z'")
    for batch in batches:
        grown = apply_inserted_dates(upsert_users(batch, grown), batch)
    whole = batches[0].unionByName(batches[1]).unionByName(batches[2])
    empty = users(("z", None)).filter("id <> 'z'")
    assert by_id(grown) == by_id(backfill_dates(upsert_users(whole, empty), whole))
