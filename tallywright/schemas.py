"""Table and landing-file schemas."""

from __future__ import annotations

from pyspark.sql import types as T

LANDING_COLUMNS = ("contribution_id", "customer_id", "amount", "fee_total", "transaction_count")

# What a contribution carries before its derived columns are added.
CONTRIBUTION_INPUT = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("contribution", T.DoubleType()),
        T.StructField("fee", T.DoubleType()),
        T.StructField("transaction_count", T.IntegerType()),
    ]
)

# Stored contributions; one row per (user_id, contrib_date).
CONTRIBUTIONS = T.StructType(
    [
        *CONTRIBUTION_INPUT.fields,
        T.StructField("total_with_fee", T.DoubleType()),
        T.StructField("fee_percentage", T.DoubleType()),
        T.StructField("contributions_created", T.TimestampType()),
        T.StructField("contributions_modified", T.TimestampType()),
        T.StructField("contrib_date", T.DateType()),
    ]
)

# Stored users; `id` is unique.
USERS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("date_joined", T.DateType()),
        T.StructField("last_contrib", T.TimestampNTZType()),
        T.StructField("users_created", T.TimestampType()),
        T.StructField("users_modified", T.TimestampType()),
    ]
)

# Landing files that a store has loaded; known by root and key.
LANDED_FILES = T.StructType(
    [
        T.StructField("landing_root", T.StringType(), False),
        T.StructField("key", T.StringType(), False),
        T.StructField("landing_day", T.DateType()),
    ]
)
