"""The registered queries of the pipeline's operators on the smallest tables."""

import hashlib
import re
from collections import Counter

import pytest

import __spark_entry__ as registry
import corpus_pipeline
from tallywright.llm import queries
from tallywright.llm.common import stored, table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}


def test_all_are_registered():
    names = registry.queries()
    assert {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op")} == {str(i) for i in range(1, 14)}
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_every_document_has_a_row(spark, texts, name):
    found = registry.queries()[name](spark, FOLDER).collect()
    assert Counter(r.doc_id for r in found) == Counter(texts.keys())


def test_native_queries_run_no_python(spark):
    for name in ("op1_spaced_seeds", "op3_line_templates", "op7_kd_shards"):
        plan = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_the_pipeline(spark, texts):
    docs = table(spark, FOLDER, "documents")
    columns, before = docs.columns, set(texts)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "stage")
        kept = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= before and len(kept) > len(texts) / 2
        before = set(kept)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert all(r.round_trip and r.n_chars == len(r.text) for r in docs.collect())
    assert queries.op1_spaced_seeds(spark, FOLDER).filter(f"doc_id IN ({', '.join(map(str, before))})").isEmpty()


def test_the_pipeline_takes_odd_rows(spark):
    docs = table(spark, FOLDER, "documents")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "", "en", "s", 0), (10**6, "a b", None, None, 3), (10**6, "a b", None, None, 3)],
        docs.schema,
    )
    for _, stage in corpus_pipeline.STAGES:
        odd = stored(stage(spark, odd, FOLDER), "odd")
    assert sorted(((r.doc_id, r.text) for r in odd.collect()), key=str) == [(10**6, "a b"), (None, ""), (None, None)]


def test_token_digests(spark, texts):
    for r in queries.op8_duckdb_bpe(spark, FOLDER).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
