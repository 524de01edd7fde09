from datetime import date

import pytest
from test_landing import HEADER, landing  # noqa: F401
from test_store import store  # noqa: F401

from tallywright.__main__ import main
from tallywright.plans.catalog import REPORTS, register_views, report


@pytest.fixture
def filled(store, landing):  # noqa: F811
    landing("2025-01-15", "a_20250115_190002.csv", HEADER + "1,u-a,9000,0.50,400\n2,u-b,10,1,1\n")
    landing("2025-06-20", "a_20250620_190002.csv", HEADER + "1,u-b,20,1,1\n")
    store.load_landing(landing.root)
    return store


def test_every_report_runs_on_stored_tables(filled):
    rows = {name: report(filled, name, as_of=date(2025, 6, 21)).collect() for name in REPORTS}
    assert {name: len(found) for name, found in rows.items()} == {
        "periodic_stats": 9,
        "medians": 1,
        "cohort_retention": 2,
        "cumulative_by_user": 2,
        "idle_users": 1,
        "daily_cumulative": 2,
        "new_returning_daily": 2,
        "whales_minnows": 2,
        "anniversary_totals_over": 1,
        "weekly_transactions_over": 1,
    }


def test_views(spark, filled):
    register_views(filled, as_of=date(2025, 6, 21))
    row = spark.sql("SELECT today, all_time FROM periodic_stats WHERE metric = 'unique_users'").first()
    assert tuple(row) == (1.0, 2.0)
    assert spark.sql("SELECT count(*) FROM contributions JOIN users ON users.id = user_id").first()[0] == 3


def test_today_is_the_default(filled):
    assert report(filled, "idle_users").count() == 2
    assert report(filled, "periodic_stats").filter("metric = 'unique_users'").first()["today"] is None


def test_command_line(spark, store, landing, tmp_path):  # noqa: F811
    landing("2025-01-15", "a_20250115_190002.csv", HEADER + "1,u-a,9000,0.50,400\n")
    main(["import", "--landing", landing.root, "--store", store.root])
    checkpoint = str(tmp_path / "seen")
    main(["import", "--landing", landing.root, "--store", store.root, "--new-only", "--checkpoint", checkpoint])
    main(["backfill", "--store", store.root])
    out = str(tmp_path / "out")
    main(["report", "idle_users", "--store", store.root, "--as-of", "2025-06-21", "--out", out])
    assert [r["id"] for r in spark.read.parquet(out).collect()] == ["u-a"]
