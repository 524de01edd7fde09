"""Every registered query against its SQL on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as registry

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_the_sql(spark, database, name):
    frame = registry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in frame.collect())
    result = database.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted([plain(r[names.index(c)]) for c in columns] for r in result.fetchall())


def test_entry(spark):
    assert registry.entry(spark).count() > 0
