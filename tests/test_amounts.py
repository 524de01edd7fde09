import random
from decimal import Decimal

from tallywright.functions.amounts import exact_mean, exact_sum


def random_amounts(rng):
    scale = rng.choice([1, 100, 10**6, 10**9, 10**13])
    places = 2 if scale > 10**6 else rng.choice([0, 2, 6])
    return [round(rng.uniform(-scale, scale) * rng.choice([1, 0.001]), places) for _ in range(rng.randint(1, 40))]


def test_sums_are_the_nearest_double(spark):
    rng = random.Random(7)
    groups = {i: random_amounts(rng) for i in range(400)}
    # Doubles beyond 2^53 millionths carry fewer than six places; compare with what they hold.
    rows = [(i, v) for i, values in groups.items() for v in values]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g int, v double").repartition(7)
    sums = dict(frame.groupBy("g").agg(exact_sum("v")).collect())
    for i, values in groups.items():
        exact = sum(Decimal(repr(v)) for v in values)
        if max(abs(v) for v in values) < 1e9:
            assert sums[i] == float(exact), (i, values)
        else:
            assert abs(Decimal(sums[i]) - exact) <= abs(exact) * Decimal("1e-15") + Decimal("0.05")


def test_totals_beyond_the_range_of_millionths(spark):
    frame = spark.range(3_000_000).selectExpr("CAST(99999999.25 AS DOUBLE) AS v")
    assert frame.agg(exact_sum("v")).first()[0] == 99999999.25 * 3_000_000


def test_order_and_partitions_do_not_matter(spark):
    rng = random.Random(3)
    values = [(rng.uniform(0, 1000),) for _ in range(5000)]
    results = set()
    for n in (1, 3, 8):
        rng.shuffle(values)
        results.add(spark.createDataFrame(values, "v double").repartition(n).agg(exact_sum("v")).first()[0])
    assert len(results) == 1


def test_nulls_are_left_out(spark):
    frame = spark.createDataFrame([(1, 1.5), (1, None), (1, 2.5), (2, None)], "g int, v double")
    rows = frame.groupBy("g").agg(exact_sum("v"), exact_mean("v")).orderBy("g").collect()
    assert [tuple(r) for r in rows] == [(1, 4.0, 2.0), (2, None, None)]


def test_places_beyond_the_sixth_count(spark):
    frame = spark.range(1_000_000).selectExpr("0.0000004D AS v", "CAST(id % 3 AS DOUBLE) / 3 AS w")
    small, thirds = frame.agg(exact_sum("v"), exact_sum("w")).first()
    assert small == 0.4 and thirds == 333333.0


def test_large_amounts(spark):
    values = [1e19, 1e19, 2.5, -1e19, 3e25, -3e25, 0.25]
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    assert frame.agg(exact_sum("v")).first()[0] == 1e19 + 2.75
    assert spark.createDataFrame([(1e26,), (-7.5,)], "v double").agg(exact_sum("v")).first()[0] == 1e26
