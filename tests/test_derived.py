from datetime import date

import pytest
from conftest import dicts
from pyspark.sql import functions as F

from tallywright.functions.amounts import count_ratio, round_half_even, round_half_up
from tallywright.functions.derived import with_full_name


def test_contribution_columns(contributions):
    rows = dicts(
        contributions(
            ("2025-06-03 19:00:00", "a", 10.0, 0.5, 3),
            ("2025-06-03 23:59:59", "b", 0.0, 0.5, 1),
            (None, "c", None, 0.5, None),
        )
    )
    assert [r["total_with_fee"] for r in rows] == [10.5, 0.5, None]
    assert [r["fee_percentage"] for r in rows] == [5.0, None, None]
    assert [r["contrib_date"] for r in rows] == [date(2025, 6, 3), date(2025, 6, 3), None]


def test_full_name_is_null_when_a_part_is(users):
    frame = with_full_name(users(("a", None, "Ann", "Lee"), ("b", None, None, "Lee"), ("c", None, "Ann", None)))
    assert [r["full_name"] for r in frame.orderBy("id").collect()] == ["Ann Lee", None, None]


@pytest.mark.parametrize(("value", "expected"), [(2.125, 2.12), (2.375, 2.38), (-2.125, -2.12), (1.0, 1.0), (None, None)])
def test_doubles_round_ties_to_even(spark, value, expected):
    assert spark.range(1).select(round_half_even(F.lit(value).cast("double"))).first()[0] == expected


def test_counts_round_ties_up(spark):
    frame = spark.createDataFrame([(1, 8), (5, 0)], "part long, whole long")
    ratio = round_half_up(count_ratio(F.col("part"), F.col("whole")), 2).cast("double")
    assert [r[0] for r in frame.select(ratio).collect()] == [0.13, None]
