import random
import zlib
from collections import Counter, defaultdict

from llm_fixtures import docs_of  # noqa: F401

from tallywright.llm import kd_shards as kd


def check(docs, rows, shards):
    texts = defaultdict(list)
    for ident, text in rows:
        texts[ident].append(text or "")
    slots = defaultdict(list)
    for r in docs:
        assert any(
            r.size == len(t.encode()) + 16 and r.text_crc32 == zlib.crc32(t.encode()) for t in texts[r.doc_id]
        )
        slots[r.shard].append(r.slot)
    assert Counter(r.doc_id for r in docs) == Counter(i for i, _ in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_bytes_are_near_equal_and_copies_stay_together(spark, docs_of):
    random.seed(4)
    rows = [(i, "ab é "[: random.randrange(6)] * random.randrange(40)) for i in range(3000)]
    rows += [(3000 + i, "the same text " * 3) for i in range(30)]
    found = kd.kd_shards(docs_of(*rows), shards=7).collect()
    check(found, rows, 7)
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 7
    assert max(sizes.values()) < 1.06 * mean and min(sizes.values()) > 0.94 * mean
    assert len({r.shard for r in found if 3000 <= r.doc_id < 3030}) == 1


def test_a_group_of_copies_larger_than_a_shard_is_dealt_out(spark, docs_of):
    rows = [(i, "x" * 100) for i in range(800)] + [(800 + i, "y" * i) for i in range(100)]
    found = kd.kd_shards(docs_of(*rows), shards=5).collect()
    check(found, rows, 5)
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.15 * sum(sizes.values()) / 5


def test_odd_rows(spark, docs_of):
    rows = [(1, None), (1, None), (None, "a"), (2, ""), (3, "x" * 50_000)]
    check(kd.kd_shards(docs_of(*rows), shards=4).collect(), rows, 4)
    assert kd.kd_shards(docs_of(*rows).limit(0), shards=4).collect() == []
    assert {r.shard for r in kd.kd_shards(docs_of(*rows), target_bytes=10**9).collect()} == {0}


def test_no_python_in_the_plan(spark, docs_of):
    plan = kd.kd_shards(docs_of((1, "a"), (2, "b")), shards=2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
