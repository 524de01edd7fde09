"""Each stage of the pipeline on odd rows and on tables whose columns are named like its own."""

import pytest

import corpus_pipeline
from llm_fixtures import docs_of  # noqa: F401
from test_texts import prose

FOLDER = "/root/testdata/sf0.001"
CLASHING = "row_key long, toxicity double, toxic_passages string, dropped_lines string, kept boolean, decoded string, class_id long"


@pytest.fixture(scope="module")
def odd(spark):
    text = " ".join(prose(3, 40))
    rows = [(None, None), (None, None), (1, ""), (2, text), (2, text), (3, text + " more"), (9, text + " end"), (9, " ".join(prose(4, 40)))]
    more = [(i, 0.5, "p", "d", True, "x", -i) for i in range(len(rows))]
    return spark.createDataFrame(
        [(i, t, "en", "s", None if t is None else len(t)) + m for (i, t), m in zip(rows, more, strict=True)],
        f"doc_id long, text string, lang string, source string, n_chars int, {CLASHING}",
    )


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_of_any_name_come_back_as_they_were(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    left = stage(spark, odd, FOLDER)
    assert left.columns == odd.columns
    before = {tuple(r) for r in odd.collect()}
    after = [tuple(r) for r in left.collect()]
    assert after and set(after) <= before
    assert stage(spark, odd.limit(0), FOLDER).collect() == []


def test_near_copies_go_by_row_and_not_by_id(spark, odd):
    left = corpus_pipeline.drop_near_copies(spark, odd, FOLDER).collect()
    kept = sorted(((r.doc_id, r.text) for r in left), key=str)
    copies = [(i, t) for i, t in kept if t and t.startswith(" ".join(prose(3, 40)))]
    assert len(copies) == 1  # of the texts of 2, 2, 3 and one of 9
    assert (9, " ".join(prose(4, 40))) in kept and (1, "") in kept
    assert sum(i is None and t is None for i, t in kept) == 2  # they differ in other columns


def test_rows_that_repeat_as_a_whole_stay_once(spark, odd):
    first = odd.limit(1)
    assert corpus_pipeline.drop_near_copies(spark, first.union(first).union(first), FOLDER).count() == 1
