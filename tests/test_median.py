import math
import random
import re
import statistics
import struct

import pytest

from tallywright import plans
from tallywright.operators.median import exact_medians, with_image


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 101, 1000])
def test_matches_the_sorted_middle(spark, n):
    rng = random.Random(n)
    rows = [(rng.lognormvariate(0, 3), float(rng.randint(0, 3)), None if i % 5 else rng.random()) for i in range(n)]
    frame = spark.createDataFrame(rows, "a double, b double, c double")
    expected = [
        statistics.median(v) if (v := [r[i] for r in rows if r[i] is not None]) else None for i in range(3)
    ]
    assert list(exact_medians(frame, ["a", "b", "c"]).first()) == expected


def test_large_skewed_input(spark):
    frame = spark.range(60_001).selectExpr("IF(id % 3 = 0, 0.0D, sqrt(id)) AS v", "CAST(-id AS DOUBLE) AS w")
    values = sorted(0.0 if i % 3 == 0 else i**0.5 for i in range(60_001))
    row = exact_medians(frame, ["v", "w"]).first()
    assert row["v"] == pytest.approx(values[30_000], rel=1e-15)
    assert row["w"] == -30_000.0


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 30_001])
def test_ties_and_skew(spark, n):
    frame = spark.range(n).selectExpr("IF(id % 3 = 0, 0.0D, exp(id / 5000)) AS v", "CAST(id % 7 AS DOUBLE) AS w")
    rows = frame.collect()
    row = exact_medians(frame, ["v", "w"]).first()
    for name in ("v", "w"):
        values = sorted(r[name] for r in rows)
        assert row[name] == (values[(n - 1) // 2] + values[n // 2]) / 2


def _odd_values() -> list[float]:
    rng = random.Random(7)
    powers = [math.ldexp(1.0, e) for e in range(-1074, 1024)]
    near = [math.nextafter(p, d) for p in powers for d in (0.0, math.inf)]
    bits = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(2000)]
    finite = [x for x in [*powers, *near, *bits, 0.1, 1 / 3] if not math.isnan(x)]
    return [0.0, -0.0, math.inf, -math.inf, *finite, *[-x for x in finite]]


def test_images_keep_the_order_of_doubles(spark):
    values = _odd_values()
    frame = spark.createDataFrame([("c", x) for x in [*values, math.nan]], "column string, value double")
    rows = with_image(frame).collect()
    nan = [r.image for r in rows if math.isnan(r.value)]
    rest = sorted(((r.value, r.image) for r in rows if not math.isnan(r.value)), key=lambda r: r[0])
    assert all((a[0] < b[0]) == (a[1] < b[1]) and (a[0] == b[0]) == (a[1] == b[1]) for a, b in zip(rest, rest[1:], strict=False))
    assert nan[0] > rest[-1][1]


@pytest.mark.parametrize("case", ["all", "odd count", "negative", "infinite", "subnormal", "neighbours", "opposite"])
def test_odd_values(spark, case):
    all_values = _odd_values()
    values = {
        "all": all_values,
        "odd count": [*all_values, 5.0],
        "negative": [-3.5, -1e300, -1e-300, -3.5],
        "infinite": [math.inf, 1.0, math.inf, -math.inf, math.inf],
        "subnormal": [5e-324, 1e-320, 1.5e-310, -5e-324],
        "neighbours": [1.0 + i * 2**-52 for i in range(999)],
        "opposite": [-1e308, 1e-308],
    }[case]
    frame = spark.createDataFrame([(x,) for x in values], "v double").repartition(3)
    ordered, n = sorted(values), len(values)
    assert exact_medians(frame, ["v"]).first()[0] == (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


def test_no_value_is_sorted_or_sketched(users, contributions):
    rows = contributions(("2025-01-02 00:00:00", "a"), ("2025-01-03 00:00:00", "a"))
    plan = plans.medians(users(("a", "2025-01-01")), rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    assert set(re.findall(r"windowspecdefinition\([^)]*?(\w+)#\d+L? ASC", plan)) == {"part"}
