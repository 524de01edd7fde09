"""User ids that are compared by a collation instead of byte by byte.

A collated column keeps its spelling. Grouping, joins, anti joins, windows and DISTINCT of
Spark treat spellings that the collation holds equal as one key, so the operators and reports
need no second form: they follow the type of the id columns they are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Case, accents and blanks at the end make no difference.
CASE_AND_ACCENT_INSENSITIVE = "UNICODE_CI_AI_RTRIM"

_BINARY = "UTF8_BINARY"


def collated(df: DataFrame, collation: str | None, *columns: str) -> DataFrame:
    """`df` with string columns under a collation; unchanged without one."""
    if collation is None:
        return df
    return df.withColumns({name: F.collate(name, collation) for name in columns})


def spelled(column: str | Column) -> Column:
    """A string column as it is written, compared byte by byte."""
    return F.collate(column, _BINARY)


def is_collated(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType
    return isinstance(kind, T.StringType) and kind.collation != _BINARY
