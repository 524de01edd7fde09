"""Exact sums and the rounding rules of amounts and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
WHOLE = T.DecimalType(18, 0)
COUNT = T.DecimalType(20, 0)

# Amounts are summed in four whole-number parts, each exact: multiples of LARGE, units,
# millionths, and what is left of a millionth in MICRO * FINE parts of a unit.
LARGE = 2**40
MICRO = 1_000_000
FINE = 1_000_000_000

# Amounts from here on are not taken in: their parts would not fit.
AMOUNT_LIMIT = 1e27


def exact_sum(amount: str, over: str = "") -> Column:
    """Sum of a column of doubles below AMOUNT_LIMIT, each to fifteen digits, as the double nearest to it.

    (Among amounts over 1e12 it may be the next one.)

    The parts are summed apart as integers, so the result depends neither on row order
    nor on how the rows were spread over tasks, and the hot loop stays in primitive
    arithmetic. Each integer sum holds for more than 3e9 rows of any size and 8e12 rows of
    amounts below 1e12; beyond, Spark's default (ANSI) arithmetic raises an error.

    `over` is the SQL of a window clause.
    """
    # Casts cut towards zero, so that differences of what is left are exact for either sign.
    large = f"CAST({amount} / {LARGE}D AS BIGINT)"
    rest_of_large = f"({amount} - {large} * {LARGE}D)"
    units = f"CAST({rest_of_large} AS BIGINT)"
    micro = f"(({rest_of_large} - {units}) * {MICRO})"
    whole = lambda part: f"sum(CAST({part} AS BIGINT)) {over}"
    millionths = whole(f"rint({micro})")
    # What lies beyond fifteen digits is not the amount's but the double's that holds it.
    step = f"pow(10D, ceil(log10(greatest(abs({amount}), 1D))))"
    rest = whole(f"rint(({micro} - rint({micro})) * {FINE} / {step}) * {step}")
    # Once per group: millionths carry over into units, and a decimal is rounded to a double a single time.
    carried = f"({whole(units)} + ({millionths} + {rest} DIV {FINE}) DIV {MICRO})"
    below = f"(({millionths} + {rest} DIV {FINE}) % {MICRO} * {FINE} + {rest} % {FINE})"
    unit = "CAST('0.000000000000001' AS DECIMAL(16, 15))"
    small = f"CAST(CAST({carried} AS DECIMAL(20, 0)) + CAST({below} AS DECIMAL(16, 0)) * {unit} AS DOUBLE)"
    return F.expr(f"{whole(large)} * {LARGE}D + {small}")


def exact_mean(amount: str) -> Column:
    """Mean of a column of doubles over the exact sum; NULLs left out."""
    return exact_sum(amount) / F.expr(f"nullif(count({amount}), 0)")


def round_half_even(value: Column, places: int = 2) -> Column:
    """Rounding of approximate (double) values: ties to the even neighbour."""
    scale = F.lit(float(10**places))
    return F.rint(value * scale) / scale


def count_ratio(part: Column, whole: Column) -> Column:
    """Exact quotient of two counts; NULL on an empty whole."""
    return part.cast(COUNT) / F.nullif(whole.cast(COUNT), F.lit(0).cast(COUNT))


def round_half_up(value: Column, places: int) -> Column:
    """Rounding of exact (decimal) values: ties away from zero."""
    return F.round(value, places)
