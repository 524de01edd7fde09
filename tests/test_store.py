from datetime import date, datetime

import pytest
from test_landing import HEADER, landing  # noqa: F401

from tallywright.schemas import CONTRIBUTIONS, USERS
from tallywright.sources.landing import LandingError
from tallywright.sources.store import ContributionStore
from tallywright.streaming.incremental import import_new_files


@pytest.fixture
def store(spark, tmp_path_factory):
    return ContributionStore(spark, str(tmp_path_factory.mktemp("store")))


def stored(store):
    return {(r["user_id"], r["contrib_date"]): r["contribution"] for r in store.contributions().collect()}


def members(store):
    return {r["id"]: (r["date_joined"], r["last_contrib"]) for r in store.users().collect()}


def test_an_empty_store_has_both_tables(store):
    assert store.contributions().schema.names == CONTRIBUTIONS.names and store.contributions().count() == 0
    assert store.users().schema.names == USERS.names and store.users().count() == 0


def test_first_wins_within_and_across_files_and_runs(spark, store, landing):  # noqa: F811
    landing("2025-01-15", "b_20250115_190002.csv", HEADER + "1,u-a,10.50,0.50,3\n2,u-b,0,0,1\n3,u-a,99.00,9.00,9\n")
    landing("2025-01-15", "a_20250115_200000.csv", HEADER + "1,u-a,77,1,1\n2,u-c,5,1,1\n")
    landing("2025-01-16", "a_20250116_190002.csv", HEADER + "1,u-a,8,1,1\n")
    store.load_landing(landing.root)
    expected = {
        ("u-a", date(2025, 1, 15)): 10.5,
        ("u-b", date(2025, 1, 15)): 0.0,
        ("u-c", date(2025, 1, 15)): 5.0,
        ("u-a", date(2025, 1, 16)): 8.0,
    }
    assert stored(store) == expected
    row = store.contributions().filter("user_id = 'u-a' AND contrib_date = DATE'2025-01-15'").first()
    assert row["timestamp"] == datetime(2025, 1, 15, 19, 0, 2)
    assert row["total_with_fee"] == 11.0 and row["fee_percentage"] == pytest.approx(0.5 / 10.5 * 100)
    assert row["contributions_created"] is not None
    assert members(store) == {
        "u-a": (date(2025, 1, 15), datetime(2025, 1, 16)),
        "u-b": (date(2025, 1, 15), datetime(2025, 1, 15)),
        "u-c": (date(2025, 1, 15), datetime(2025, 1, 15)),
    }

    store.load_landing(landing.root)
    assert stored(store) == expected and store.contributions().count() == 4

    # A late file only fills days that are still free.
    landing("2025-01-14", "late_20250114_080000.csv", HEADER + "1,u-a,1,1,1\n")
    landing("2025-01-15", "late_20250115_080000.csv", HEADER + "1,u-a,1,1,1\n")
    store.load_landing(landing.root)
    assert stored(store) == {**expected, ("u-a", date(2025, 1, 14)): 1.0}
    assert members(store)["u-a"] == (date(2025, 1, 14), datetime(2025, 1, 16))


def test_a_bad_file_leaves_the_store_unchanged(store, landing):  # noqa: F811
    landing("2025-01-15", "a_20250115_190002.csv", HEADER + "1,u-a,1,1,1\n")
    landing("2025-01-16", "a_20250116_190002.csv", HEADER + "1,u-b,x,1,1\n")
    with pytest.raises(LandingError):
        store.load_landing(landing.root)
    assert store.contributions().count() == 0 and store.users().count() == 0


def test_nothing_to_load(store, landing):  # noqa: F811
    landing("2025-01-15", "a_20250115_190002.CSV", HEADER + "1,u-a,1,1,1\n")
    store.load_landing(landing.root)
    landing("2025-01-15", "a_20250115_190002.csv", HEADER)
    store.load_landing(landing.root)
    assert store.contributions().count() == 0


def test_historic_rows_and_backfill(store, contributions):
    history = contributions(
        ("2024-06-03 19:00:00", "a", 5.0, 0.0, None),
        ("2024-06-03 20:00:00", "a", 6.0, 0.0, None),
        ("2024-06-10 19:00:00", "a", 0.0, 0.0, None),
        ("2024-06-10 19:00:00", "b", 7.0, 1.0, None),
    ).select("timestamp", "user_id", "contribution", "fee", "transaction_count")
    store.load_rows(history, ["timestamp"])
    assert stored(store)["a", date(2024, 6, 3)] == 5.0 and store.contributions().count() == 3
    before = members(store)
    store.backfill_users()
    assert members(store) == before == {
        "a": (date(2024, 6, 3), datetime(2024, 6, 10)),
        "b": (date(2024, 6, 10), datetime(2024, 6, 10)),
    }


def test_rows_without_a_time_are_all_kept(store, contributions):
    columns = ["timestamp", "user_id", "contribution", "fee", "transaction_count"]
    rows = contributions((None, "a", 1.0), (None, "a", 2.0), ("2024-06-03 19:00:00", "a", 3.0))
    store.load_rows(rows.select(columns), ["timestamp"])
    assert sorted(r["contribution"] for r in store.contributions().collect()) == [1.0, 2.0, 3.0]
    assert store.contributions().filter("contrib_date IS NULL").count() == 2
    assert members(store) == {"a": (date(2024, 6, 3), datetime(2024, 6, 3))}


def test_only_the_days_of_the_load_are_compared(store, contributions, spark):
    columns = ["timestamp", "user_id", "contribution", "fee", "transaction_count"]
    store.load_rows(contributions(("2024-06-03 19:00:00", "a"), ("2024-06-04 19:00:00", "a")).select(columns), ["timestamp"])
    day = store.contributions().filter("contrib_date IN (DATE'2024-06-04')")
    assert len(day.inputFiles()) == 2  # before pruning
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(contrib_date" in plan or "PartitionFilters: [(contrib_date" in plan


def test_recurring_import_takes_each_file_once(spark, store, landing, tmp_path_factory, monkeypatch):  # noqa: F811
    checkpoint = str(tmp_path_factory.mktemp("stream"))
    seen = []
    original = ContributionStore.load_files

    def spy(self, files, **options):
        seen.extend(sorted(r["key"].rsplit("/", 1)[1] for r in files.collect()))
        original(self, files, **options)

    monkeypatch.setattr(ContributionStore, "load_files", spy)

    def run():
        query = import_new_files(store, landing.root, checkpoint_location=checkpoint)
        assert query.awaitTermination(120)
        if query.exception() is not None:
            raise query.exception()

    landing("2025-01-15", "z_20250115_190002.csv", HEADER + "1,u-a,1,1,1\n")
    landing("2025-01-15", "a_20250115_200000.csv", HEADER + "1,u-a,2,1,1\n")
    landing("2025-01-15", "skipped.txt", "nothing")
    run()
    assert stored(store) == {("u-a", date(2025, 1, 15)): 1.0}
    landing("2025-01-16", "a_20250116_190002.csv", HEADER + "1,u-b,3,1,1\n")
    run()
    run()
    assert stored(store) == {("u-a", date(2025, 1, 15)): 1.0, ("u-b", date(2025, 1, 16)): 3.0}
    assert seen == ["a_20250115_200000.csv", "z_20250115_190002.csv", "a_20250116_190002.csv"]
