"""The test events as landing files, so that loads of files can be checked against the tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallywright.sources.files import move, names_in
from tallywright.sources.landing import PREFIX
from tallywright.sources.sample_tables import event_rows

# Two exports a day, stamped with the hour they begin.
HALF_DAY = "date_trunc('DAY', timestamp) + make_dt_interval(0, 12 * (hour(timestamp) DIV 12))"

_COLUMNS = {
    "contribution_id": "CAST(arrival AS STRING)",
    "customer_id": "user_id",
    "amount": "CAST(contribution AS STRING)",
    "fee_total": "CAST(fee AS STRING)",
    "transaction_count": "CAST(transaction_count AS STRING)",
}


def write_landing_files(spark: SparkSession, folder: str, root: str, where: str = "true") -> int:
    """Writes the events that meet a condition (on `stamp` too) as files below `root`; their number.

    Files of even days start with a byte order mark; those of odd days have their columns in
    another order, with quotes and one column more. Lines are in order of event ids.
    """
    rows = event_rows(spark, folder).withColumn("stamp", F.expr(HALF_DAY)).filter(where)
    odd = F.dayofmonth("stamp") % 2 == 1
    plain = F.concat_ws(",", *[F.expr(e) for e in _COLUMNS.values()])
    turned = F.concat_ws(",", F.lit('"a ""note"", quoted"'), *[F.concat(F.lit('"'), F.expr(e), F.lit('"')) for e in reversed(_COLUMNS.values())])
    header = F.when(odd, ",".join(["note", *reversed(_COLUMNS)])).otherwise("\ufeff" + ",".join(_COLUMNS))
    name = F.date_format("stamp", "yyyyMMdd_HHmmss").alias("name")
    lines = rows.select(name, F.col("arrival").alias("line"), F.when(odd, turned).otherwise(plain).alias("value"))
    headers = rows.select(name, F.lit(-1).cast("long").alias("line"), header.alias("value")).distinct()
    written = f"{root}/written"
    lines.union(headers).repartition("name").sortWithinPartitions("name", "line").select("name", "value").write.partitionBy("name").mode(
        "overwrite"
    ).text(written)
    folders = [f for f in names_in(spark, written) if f.startswith("name=")]
    for found in folders:
        stamp = found.removeprefix("name=")
        for i, part in enumerate(p for p in names_in(spark, f"{written}/{found}") if p.startswith("part-")):
            day = f"year={stamp[:4]}/month={stamp[4:6]}/day={stamp[6:8]}"
            move(spark, f"{written}/{found}/{part}", f"{root}/{PREFIX}{day}/export{i}_{stamp}.csv")
    return len(folders)
