"""Exact duplicates, against grouping by the texts themselves."""

import hashlib
from collections import defaultdict

from llm_fixtures import docs_of  # noqa: F401
from tallywright.llm.exact_groups import PREFIX_CHARS, drop_exact_copies, exact_groups

HEAD = "h" * (PREFIX_CHARS + 10)

ROWS = [
    (1, "a b"), (2, "a b"), (7, "a b"),
    (3, None), (4, ""),
    (5, HEAD + "x"), (6, HEAD + "y"), (8, HEAD + "x"),  # one length and prefix, two texts
    (9, HEAD), (10, "ä" * 3), (11, "ä" * 2), (12, "abcdef"),  # six bytes each
    (None, "n"), (13, "n"), (None, "nobody"), (None, "nobody"),
    (14, "same row"), (14, "same row"), (15, "z" * 300_000), (16, "z" * 300_000), (17, "z" * 299_999 + "y"),
]


def test_groups_equal_those_by_text(spark, docs_of):
    found = exact_groups(docs_of(*ROWS), every_digest=True).collect()
    members = defaultdict(list)
    for key, text in ROWS:
        members[text or ""].append(key)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): keys for t, keys in members.items()}
    assert sorted(str(r.doc_id) for r in found) == sorted(str(k) for k, _ in ROWS)
    for r in found:
        keys = by_digest[r.digest]
        assert r.doc_id in keys and r.group_size == len(keys)
        assert r.keep_id == max((k for k in keys if k is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    for digest in by_digest:
        assert sum(r.kept for r in found if r.digest == digest) == 1


def test_whole_texts_are_hashed_only_where_length_and_prefix_agree(spark, docs_of):
    found = {r.doc_id: r for r in exact_groups(docs_of((1, "one"), (2, "four"), (3, HEAD + "x"), (4, HEAD + "y"))).collect()}
    assert found[1].digest is None and found[2].digest is None
    assert found[3].digest == hashlib.sha256((HEAD + "x").encode()).hexdigest() and found[3].group_size == 1
    assert all(r.kept and r.keep_id == r.doc_id for r in found.values())


def test_copies_are_dropped_with_all_columns_kept(spark):
    rows = [(1, "a", "x", 5), (2, "a", "y", 6), (None, "b", None, None), (None, "b", None, None), (3, None, "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, group_size long")
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(2, "a", "y", 6), (None, "b", None, None), (3, None, "k", 1)], key=str)


def test_an_empty_table(spark, docs_of):
    none = docs_of((1, "a")).filter("false")
    assert exact_groups(none).collect() == [] and drop_exact_copies(none).collect() == []
