"""Means and deviations that do not depend on the order of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.amounts import exact_mean


def exact_moments(rows: DataFrame, columns: Sequence[str], *more: Column) -> DataFrame:
    """One row: mean_<c> and spread_<c> (the population's standard deviation) of each column, NULLs left out, and `more` aggregates.

    Sums are exact, so the same values give the same bits however they are spread over tasks.
    Deviations from the mean are squared in a second pass, as parts of a power of two that none
    of them exceeds: neither large nor close values lose digits, and the squares of very large
    ones still fit. Both passes combine on the map side; between them goes one row.
    """
    first = rows.agg(
        *[exact_mean(c).alias(f"mean_{c}") for c in columns],
        *[F.max(c).alias(f"most_{c}") for c in columns],
        *[F.min(c).alias(f"least_{c}") for c in columns],
        *more,
    )
    reach = {c: f"greatest(most_{c} - mean_{c}, mean_{c} - least_{c})" for c in columns}
    scaled = first.withColumns({f"unit_{c}": F.expr(f"IF({reach[c]} > 0, pow(2D, ceil(log2({reach[c]}))), 1D)") for c in columns})
    levels = scaled.drop(*[f"{end}_{c}" for end in ("most", "least") for c in columns])
    squares = rows.crossJoin(F.broadcast(levels)).select(
        *[F.expr(f"({c} - mean_{c}) / unit_{c} * (({c} - mean_{c}) / unit_{c})").alias(c) for c in columns]
    )
    second = squares.agg(*[F.sqrt(exact_mean(c)).alias(f"root_{c}") for c in columns])
    kept = [c for c in levels.columns if not c.startswith("unit_")]
    return levels.crossJoin(F.broadcast(second)).select(
        *kept, *[(F.col(f"root_{c}") * F.col(f"unit_{c}")).alias(f"spread_{c}") for c in columns]
    )
