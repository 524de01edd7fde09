"""Upsert of users and upkeep of their first and last contribution dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.clock import utc_day
from tallywright.functions.collation import is_collated, spelled


def _distinct_ids(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """(id): every id in `rows` once; under a collation in the spelling that comes first in `order`."""
    if not is_collated(rows, "user_id"):
        return rows.select(F.col("user_id").alias("id")).distinct()
    written = spelled("user_id")
    kind = rows.schema["user_id"].dataType
    first = F.min_by(written, F.struct(*order, written))
    return rows.groupBy("user_id").agg(first.alias("_first")).select(F.collate("_first", kind.collation).alias("id"))


def new_users(rows: DataFrame, users: DataFrame, order: Sequence[Column | str] = ()) -> DataFrame:
    """Ids in `rows` that `users` does not hold, once each, as bare users."""
    fresh = _distinct_ids(rows, order).join(users.select("id"), "id", "left_anti")
    now = F.current_timestamp()
    filled = {"users_created": now, "users_modified": now}
    return fresh.select(
        "id", *[filled.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in users.schema if f.name != "id"]
    )


def upsert_users(rows: DataFrame, users: DataFrame, order: Sequence[Column | str] = ()) -> DataFrame:
    return users.unionByName(new_users(rows, users, order))


def _contribution_span(contributions: DataFrame) -> DataFrame:
    day = utc_day("timestamp")
    return contributions.groupBy(F.col("user_id").alias("id")).agg(
        F.min(day).alias("_first"), F.max(day).cast("timestamp_ntz").alias("_last"), F.lit(True).alias("_seen")
    )


def _set_dates(users: DataFrame, span: DataFrame, date_joined: Column, last_contrib: Column) -> DataFrame:
    values = {"date_joined": date_joined, "last_contrib": last_contrib}
    changed = ~F.col("date_joined").eqNullSafe(date_joined) | ~F.col("last_contrib").eqNullSafe(last_contrib)
    if "users_modified" in users.columns:
        values["users_modified"] = F.when(changed, F.current_timestamp()).otherwise(F.col("users_modified"))
    return users.join(span, "id", "left").select(
        *[values.get(name, F.col(name)).alias(name) for name in users.columns]
    )


def apply_inserted_dates(users: DataFrame, inserted: DataFrame) -> DataFrame:
    """Widen the dates by rows just inserted: joined can only go back, last only forward."""
    return _set_dates(
        users,
        _contribution_span(inserted),
        F.least("date_joined", "_first"),
        F.greatest("last_contrib", "_last"),
    )


def backfill_dates(users: DataFrame, contributions: DataFrame) -> DataFrame:
    """Overwrite the dates from the whole history; users without rows keep theirs."""
    return _set_dates(
        users,
        _contribution_span(contributions),
        F.when(F.col("_seen"), F.col("_first")).otherwise(F.col("date_joined")),
        F.when(F.col("_seen"), F.col("_last")).otherwise(F.col("last_contrib")),
    )
