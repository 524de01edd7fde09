"""Means and deviations against exact fractions, in any order of rows."""

import random
from datetime import date
from fractions import Fraction
from math import sqrt

import pytest
from pyspark.sql import functions as F

from tallywright.functions.amounts import exact_mean
from tallywright.operators.moments import exact_moments
from tallywright.plans.segments import whales_minnows


def by_fractions(values):
    exact = [Fraction(v) for v in values]
    mean = sum(exact) / len(exact)
    return float(mean), sqrt(sum((v - mean) ** 2 for v in exact) / len(exact))


CASES = {
    "mixed": [0.1 * i * (-1) ** i + 1 / 3 for i in range(200)],
    "large and small": [1e12, 1e-3, 5e11, 0.0, -7e11, 12.34],
    "close": [1_000_000 + i / 1000 for i in range(100)],
    "huge": [1e26, 3e26, 2.5e26],
    "equal": [0.1] * 50,
}


@pytest.mark.parametrize("name", CASES)
def test_moments_are_right_and_the_same_in_any_order(spark, name):
    values = CASES[name]
    found = set()
    for seed in range(5 if name != "mixed" else 20):
        shuffled = random.Random(seed).sample(values, len(values))
        rows = spark.createDataFrame([(v,) for v in shuffled], "x double").repartition(1 + seed % 4)
        found.add(tuple(exact_moments(rows, ["x"]).select("mean_x", "spread_x").first()))
    assert len(found) == 1
    mean, spread = by_fractions(values)
    assert found.pop() == (pytest.approx(mean, rel=1e-14), pytest.approx(spread, rel=1e-9, abs=1e-15 * abs(mean)))


def test_nulls_empty_rows_and_further_aggregates(spark):
    rows = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "x double, y double")
    row = exact_moments(rows, ["x", "y"], F.count(F.lit(1)).alias("n")).first()
    assert (row.mean_x, row.spread_x, row.mean_y, row.spread_y, row.n) == (2.0, 1.0, None, None, 3)
    assert exact_moments(rows.filter("false"), ["x"]).first().spread_x is None


def test_a_user_on_the_border_keeps_their_class(spark, users, contributions):
    """Mean 2, deviation 1 (times the factor): users at exactly one deviation are dolphins, in any order."""
    amounts = {"a": 1.0, "b": 1.0, "c": 3.0, "d": 3.0}
    classes = set()
    for seed in range(6):
        order = random.Random(seed).sample(sorted(amounts), 4)
        rows = contributions(*[("2024-06-10 10:00", u, amounts[u], amounts[u] / 10, 1) for u in order]).repartition(1 + seed % 3)
        people = users(*[(u, "2024-06-09") for u in order])
        found = whales_minnows(people, rows, as_of=date(2024, 6, 10)).collect()
        classes.add(tuple(sorted((r["user_id"], r["user_class_by_contribution"]) for r in found)))
    assert classes == {tuple((u, "dolphin") for u in "abcd")}


def test_two_users_are_on_the_border_whatever_their_last_digits(spark, users, contributions):
    """Each of two is one deviation from their mean; as doubles 1 and 7, or 2 and 4.1, times the factor are beyond it."""
    rows = contributions(("2024-06-10 10:00", "a", 2.0, 1.0, 1), ("2024-06-10 10:00", "b", 4.1, 7.0, 1))
    found = whales_minnows(users(("a", "2024-06-09"), ("b", "2024-06-09")), rows, as_of=date(2024, 6, 10)).collect()
    assert [(r["user_class_by_fee"], r["user_class_by_contribution"]) for r in found] == [("dolphin", "dolphin")] * 2


def test_mean_of_days_does_not_depend_on_order(spark):
    values = [0.1, 0.2, 0.3, 1e9 + 0.7, 1 / 3] * 7
    found = {
        spark.createDataFrame([(v,) for v in random.Random(s).sample(values, len(values))], "x double").repartition(3).agg(exact_mean("x")).first()[0]
        for s in range(8)
    }
    assert len(found) == 1
