"""Cleans a corpus of documents and turns it into tokens, stage by stage.

Each stage is a function of (spark, docs, sf_dir) that takes all rows its predecessor kept
and returns, but for the last, the columns of `documents`. Stages hold for any rows: null
and repeated ids, null, empty and repeated texts. Rows are decided one by one, by id and
text, never by id alone. Columns other than doc_id and text go through under names of their
own, so that none of theirs can meet one that a stage makes. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import decontaminate, line_templates, order_minhash, queries, toxic_segments
from tallywright.llm.common import stored, table

_TAKEN = ("doc_id", "text")


def _apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`stage` over `docs` with all columns but doc_id and text renamed, and the columns of `docs` of what it returns."""
    names = [c if c in _TAKEN else f"column_{i}" for i, c in enumerate(docs.columns)]
    passed = stage(docs.toDF(*names))
    return passed.select([F.col(name).alias(c) for name, c in zip(names, docs.columns, strict=True)])


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with row_key, a hash of id and text."""
    return docs.withColumn("row_key", F.xxhash64("doc_id", "text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; learnt from the labels of `sf_dir`. Null and empty texts pass."""

    def stage(rows: DataFrame) -> DataFrame:
        return queries.toxicity(spark, rows, sf_dir).filter(toxic_segments.toxic(F.col("toxicity")) == 0)

    return _apart(docs, stage)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose templates recur across documents; n_chars follows the text, null texts stay."""
    cleaned = _apart(docs, line_templates.drop_recurring_lines)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Of rows that repeat id and text one stays, of rows without words one of those that repeat as a whole.
    """

    def stage(rows: DataFrame) -> DataFrame:
        keyed = _keyed(rows)
        found = stored(order_minhash.near_duplicates(keyed, key="row_key"), "near-duplicates")
        if not found.groupBy("doc_id").count().filter("count > 1").isEmpty():
            wordless = ~F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False))
            whole = F.when(wordless, F.xxhash64(*[c for c in rows.columns if c not in _TAKEN])) if len(rows.columns) > 2 else F.lit(None)
            keyed = keyed.withColumn("row_rest", whole).dropDuplicates(["row_key", "row_rest"])
        gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("row_key")).distinct()
        return keyed.join(gone, "row_key", "left_anti")

    return _apart(docs, stage)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; null and empty texts pass."""

    def stage(rows: DataFrame) -> DataFrame:
        keyed = _keyed(rows)
        found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), key="row_key")
        leaks = stored(found.select(F.col("doc_id").alias("row_key")).distinct(), "contaminated")
        return keyed.join(leaks, "row_key", "left_anti")

    return _apart(docs, stage)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token_ids, n_tokens, and round_trip: whether the ids decode to the text (null: empty).

    Columns of `docs` that have one of these names are replaced.
    """
    found = queries.token_ids(docs)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return found.withColumns({"n_tokens": F.size("token_ids").cast("long"), "round_trip": same}).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte-level bpe", tokenize),
]

#: Hashes, models and merges of the stages are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to `documents`; between stages the rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
