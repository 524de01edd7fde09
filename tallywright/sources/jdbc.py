"""Database sink."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Fixed value: rows per INSERT.
BATCH_ROWS = 1000


def append_to_database(
    df: DataFrame,
    url: str,
    table: str,
    *,
    properties: dict[str, str] | None = None,
    batch_rows: int = BATCH_ROWS,
    connections: int = 8,
) -> None:
    """Appends `df` to a table over at most `connections` parallel connections."""
    # A shuffle of its own keeps the stages before it as wide as they are.
    df.repartition(connections).write.option("batchsize", batch_rows).jdbc(
        url, table, mode="append", properties=properties or {}
    )
