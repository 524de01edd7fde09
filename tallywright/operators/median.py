"""Exact medians by radix selection, without sorting values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bits of a value's image that are still open after each pass.
OPEN_BITS = (42, 21, 0)

_FRACTION_BITS = 52
_LEAST_EXPONENT, _MOST_EXPONENT = -1022, 1023
# Of doubles between the smallest normal and the largest one; log2 may miss the exponent by one at its borders.
_EXPONENT = "exponent + CASE WHEN size / pow(2D, exponent) >= 2 THEN 1 WHEN size / pow(2D, exponent) < 1 THEN -1 ELSE 0 END"


def with_image(values: DataFrame) -> DataFrame:
    """(column, value, image): integers in the order of the doubles `value`, equal where these are equal.

    An image is the exponent followed by the bits of the fraction, negative for negative values;
    both zeros are 0 and NaN comes after infinity, as Spark sorts it.
    """
    unit, top = f"pow(2D, {_FRACTION_BITS})", _MOST_EXPONENT + 1 - _LEAST_EXPONENT + 1
    normal = f"size >= pow(2D, {_LEAST_EXPONENT}) AND size < double('Infinity')"
    sized = values.selectExpr("column", "value", "abs(value) AS size")
    guessed = sized.selectExpr("*", f"CASE WHEN {normal} THEN CAST(floor(log2(size)) AS INT) END AS exponent")
    placed = guessed.selectExpr("column", "value", "size", f"CASE WHEN {normal} THEN {_EXPONENT} END AS exponent")
    image = (
        f"CASE WHEN exponent IS NOT NULL THEN shiftleft(CAST(exponent - {_LEAST_EXPONENT} + 1 AS BIGINT), {_FRACTION_BITS})"
        f" + CAST((size / pow(2D, exponent) - 1) * {unit} AS BIGINT)"
        f" WHEN size < 1 THEN CAST(size / pow(2D, {_LEAST_EXPONENT}) * {unit} AS BIGINT)"
        f" ELSE shiftleft({top}L, {_FRACTION_BITS}) + IF(isnan(size), 1, 0) END"
    )
    return placed.selectExpr("column", "value", f"IF(value < 0, -1, 1) * ({image}) AS image")


def exact_medians(values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact median of every column (NULLs left out; NULL where nothing is left).

    The middle ranks are found digit by digit on order-preserving integers: each pass counts
    the values of all columns by the next bits of their image, among those that agree with a
    middle value so far, and a running count over these counts tells the next bits of the
    middle ones. Counts combine on the map side, so that a shuffle holds as many rows as there
    are digits and ties cost nothing; as the two middle ranks are neighbours, one count serves
    both. Three passes, whatever the values are. Broadcasts hold one row per column.
    """
    entries = ", ".join(f"struct('{c}' AS column, CAST({c} AS DOUBLE) AS value)" for c in columns)
    images = with_image(values.selectExpr(f"inline(array({entries}))").filter("value IS NOT NULL"))
    counted = images.selectExpr("column", "value", f"shiftright(image, {OPEN_BITS[0]}) AS part").groupBy("column", "part")
    middle = _middle(
        counted.agg(F.expr("count(1) AS size"), F.expr("max(value) AS value")).selectExpr(
            "*", "0L AS below", "sum(size) OVER (PARTITION BY column) AS n"
        )
    )
    for known, still_open in zip(OPEN_BITS, OPEN_BITS[1:], strict=False):
        near = images.join(F.broadcast(middle), "column").filter(f"shiftright(image, {known}) IN (low_part, high_part)")
        counted = near.selectExpr("column", "n", "below", "value", f"shiftright(image, {still_open}) AS part")
        middle = _middle(counted.groupBy("column", "n", "below", "part").agg(F.expr("count(1) AS size"), F.expr("max(value) AS value")))
    return middle.agg(*[F.expr(f"max(IF(column = '{c}', (low + high) / 2, NULL)) AS {c}") for c in columns])


def _middle(counts: DataFrame) -> DataFrame:
    """Per column the parts that hold the two middle ranks, their largest values, and how many values lie below the first."""
    ranked = counts.selectExpr(
        "*", "below + sum(size) OVER (PARTITION BY column ORDER BY part ROWS UNBOUNDED PRECEDING) AS last_rank"
    )

    def at(rank: str, what: str, name: str):
        return F.expr(f"max(IF({rank} BETWEEN last_rank - size + 1 AND last_rank, {what}, NULL)) AS {name}")

    first, second = "(n + 1) DIV 2", "(n + 2) DIV 2"
    return ranked.groupBy("column", "n").agg(
        at(first, "part", "low_part"),
        at(second, "part", "high_part"),
        at(first, "value", "low"),
        at(second, "value", "high"),
        at(first, "last_rank - size", "below"),
    )
