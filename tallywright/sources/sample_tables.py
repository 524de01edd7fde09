"""The two tables of the model, derived from the star-schema test tables.

`events` gives a dense month with a clock time, `orders` with `customer` six
years of sparse history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.derived import with_contribution_columns
from tallywright.operators.first_wins import first_wins
from tallywright.operators.user_dimension import backfill_dates


# The schemas of the test tables, so that no file is opened to infer them.
SCHEMAS = {
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _fee(amount: str, user: str) -> str:
    """A fee in whole cents, 1 to 7 percent depending on the user."""
    return f"CAST(round({amount} * 100) AS BIGINT) * (1 + {user} % 7) DIV 100 / 100.0D"


def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a contribution row, with its arrival order."""
    rows = table(spark, folder, "events").selectExpr(
        "ts AS timestamp",
        "CAST(user_id AS STRING) AS user_id",
        "value AS contribution",
        f"{_fee('value', 'user_id')} AS fee",
        r"""CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS transaction_count""",
        "event_id AS arrival",
    )
    return with_contribution_columns(rows)


def spelled_event_rows(spark: SparkSession, folder: str) -> DataFrame:
    """`event_rows` whose user ids come in four spellings, differing in case, an accent and a blank at the end."""
    spelling = (
        "CASE arrival % 4 WHEN 0 THEN concat('Zoë-', user_id) WHEN 1 THEN concat('ZOE-', user_id)"
        " WHEN 2 THEN concat('zoe-', user_id, ' ') ELSE concat('zoë-', user_id) END"
    )
    return event_rows(spark, folder).withColumn("user_id", F.expr(spelling))


def order_rows(spark: SparkSession, folder: str, where: str = "true") -> DataFrame:
    """Every order (or those that meet a condition) as a contribution row, with its arrival order."""
    rows = table(spark, folder, "orders").filter(where).selectExpr(
        "o_orderdate AS timestamp",
        "CAST(o_custkey AS STRING) AS user_id",
        "o_totalprice AS contribution",
        f"{_fee('o_totalprice', 'o_custkey')} AS fee",
        "CAST(left(o_orderpriority, 1) AS INT) AS transaction_count",
        "o_orderkey AS arrival",
    )
    return with_contribution_columns(rows)


def _stored(rows: DataFrame) -> DataFrame:
    return first_wins(rows, ["timestamp", "arrival"]).drop("arrival")


def event_contributions(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(event_rows(spark, folder))


def order_contributions(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(order_rows(spark, folder))


def bare_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as users that have no dates yet."""
    return table(spark, folder, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS id",
        "c_name AS first_name",
        "c_mktsegment AS last_name",
        "CAST(NULL AS DATE) AS date_joined",
        "CAST(NULL AS TIMESTAMP_NTZ) AS last_contrib",
    )


def order_users(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with the dates of their orders (ignored duplicates share their day, so none is needed)."""
    return backfill_dates(bare_customers(spark, folder), order_rows(spark, folder))
