"""Nothing is lost or reordered on the way from the landing area into the store."""

import os
from datetime import date
from pathlib import Path

import pytest
from test_landing import HEADER, landing  # noqa: F401
from test_store import members, store, stored  # noqa: F401

from tallywright import __main__ as cli
from tallywright.sources.landing import LandingError, list_files
from tallywright.sources.store import ContributionStore
from tallywright.streaming.incremental import import_new_files

DAY = "2025-01-15"
FOLDER = "new_contributions/year=2025/month=01/day=15"


def run(store, root):  # noqa: F811
    query = import_new_files(store, root)
    assert query.awaitTermination(120)
    if query.exception() is not None:
        raise query.exception()


def test_late_files_are_imported_however_old(store, landing):  # noqa: F811
    landing(DAY, "new_20250115_190002.csv", HEADER + "1,u-a,1,1,1\n")
    landing(DAY, "old_20250114_190002.csv", HEADER + "1,u-a,2,1,1\n")
    old = Path(landing.root, FOLDER, "old_20250114_190002.csv")
    os.utime(old, (old.stat().st_mtime - 40 * 86400,) * 2)
    run(store, landing.root)
    assert stored(store) == {("u-a", date(2025, 1, 15)): 1.0, ("u-a", date(2025, 1, 14)): 2.0}
    landing(DAY, "older_20250113_190002.csv", HEADER + "1,u-a,3,1,1\n")
    older = Path(landing.root, FOLDER, "older_20250113_190002.csv")
    os.utime(older, (older.stat().st_mtime - 400 * 86400,) * 2)
    run(store, landing.root)
    assert stored(store)[("u-a", date(2025, 1, 13))] == 3.0


def test_every_store_remembers_its_own_imports(spark, store, landing, tmp_path_factory):  # noqa: F811
    landing(DAY, "a_20250115_190002.csv", HEADER + "1,u-a,1,1,1\n")
    other = ContributionStore(spark, str(tmp_path_factory.mktemp("other")))
    run(store, landing.root)
    run(other, landing.root)
    assert stored(store) == stored(other) == {("u-a", date(2025, 1, 15)): 1.0}


@pytest.mark.parametrize("spelling", ["{}//", "{0}/x/..", "{}/.", "file:{}", "file://{}/", "relative"])
def test_spellings_of_the_root(spark, store, landing, spelling):  # noqa: F811
    landing(DAY, "a_20250115_190002.csv", HEADER + "1,u-a,1,1,1\n")
    root = os.path.relpath(landing.root) if spelling == "relative" else spelling.format(landing.root)
    assert [r["key"] for r in list_files(spark, root).collect()] == [f"{FOLDER}/a_20250115_190002.csv"]
    store.load_landing(root)
    run(ContributionStore(spark, f"{store.root}/second"), root)
    assert len(stored(store)) == 1 and ContributionStore(spark, f"{store.root}/second").contributions().count() == 1


@pytest.mark.parametrize("name", ["_20250115_190002.csv", ".h_20250115_190002.csv"])
def test_hidden_names_are_an_error(store, landing, name):  # noqa: F811
    landing(DAY, "a_20250115_190002.csv", HEADER + "1,u-a,1,1,1\n")
    landing(DAY, name, HEADER + "1,u-b,1,1,1\n")
    landing(DAY, ".part.crc", "checksums and the like are not exports")
    for load in (store.load_landing, lambda root: run(store, root)):
        with pytest.raises(LandingError, match="hidden"):
            load(landing.root)
    assert stored(store) == {}


def test_files_of_one_stamp_go_by_their_plain_names(store, landing):  # noqa: F811
    for name, amount in (("a!b", 2), ("a b", 1), ("a+b", 3), ("a%20b", 4)):
        landing(DAY, f"{name}_20250115_190002.csv", HEADER + f"1,u-a,{amount},1,1\n")
    store.load_landing(landing.root)
    assert stored(store) == {("u-a", date(2025, 1, 15)): 1.0}


def test_names_that_look_like_patterns(store, landing):  # noqa: F811
    landing(DAY, "a[1]_20250115_190002.csv", HEADER + "1,u-a,1,1,1\n")
    landing(DAY, "a1_20250115_190003.csv", HEADER + "1,u-a,2,1,1\n2,u-b,3,1,1\n")
    landing(DAY, "{x,y}*_20250115_190004.csv", HEADER + "1,u-c,4,1,1\n")
    store.load_landing(landing.root)
    assert {user: amount for (user, _), amount in stored(store).items()} == {"u-a": 1.0, "u-b": 3.0, "u-c": 4.0}


@pytest.mark.parametrize(
    ("row", "taken"),
    [("1,u-a,\t1\t,1,1", True), ("1,u-a,1, 1 ,1\x0b", True), ("1,u-a,1e400,1,1", False), ("1,u-a,-1e300,1,1", False), ("1,u-a,1e19,1,1", True)],
)
def test_blanks_and_sizes_of_numbers(store, landing, row, taken):  # noqa: F811
    landing(DAY, "a_20250115_190002.csv", HEADER + row + "\n")
    if taken:
        store.load_landing(landing.root)
        assert len(stored(store)) == 1
    else:
        with pytest.raises(LandingError, match="amount is not a decimal"):
            store.load_landing(landing.root)


def test_line_breaks_in_quotes(store, landing):  # noqa: F811
    text = HEADER.replace("\n", ",note\n") + '1,u-a,1,1,1,"two\nlines"\n2,u-b,2,1,1,x\n'
    landing(DAY, "a_20250115_190002.csv", text)
    with pytest.raises(LandingError):
        store.load_landing(landing.root)
    store.load_landing(landing.root, multi_line=True)
    assert sorted(user for user, _ in stored(store)) == ["u-a", "u-b"]


def test_rows_are_parsed_once(spark, store, landing, monkeypatch):  # noqa: F811
    from pyspark.sql import DataFrameReader

    scans, original = [], DataFrameReader.csv
    monkeypatch.setattr(DataFrameReader, "csv", lambda self, *a, **k: scans.append(a) or original(self, *a, **k))
    landing(DAY, "a_20250115_190002.csv", HEADER + "1,u-a,1,1,1\n")
    plans = []
    load = ContributionStore._load

    def spy(self, rows, *more):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        load(self, rows, *more)

    monkeypatch.setattr(ContributionStore, "_load", spy)
    store.load_landing(landing.root)
    assert len(scans) == 1 and "csv" not in plans[0].lower().replace(".csv", "")
    assert not any(Path(store.root, "staging").iterdir())


def test_a_report_needs_a_place_or_a_preview():
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["report", "medians", "--store", "s"])
    assert cli.parser().parse_args(["report", "medians", "--store", "s", "--preview", "5"]).preview == 5
