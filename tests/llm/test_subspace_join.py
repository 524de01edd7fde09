import math
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest

from tallywright.llm import subspace_join
from tallywright.llm.block_ranges import SCALE, Reach, Region
from tallywright.llm.common import shared_folder
from tallywright.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, component_id string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute(rows, threshold=0.98):
    good = []
    for i, (ident, v, label) in enumerate(rows):
        if ident is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.append((i, np.array(np.float32(v), float)))
    links = {i: set() for i in range(len(rows))}
    for a, x in good:
        for b, y in good:
            if a < b and rows[a][2] == rows[b][2] and len(x) == len(y):
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for i, (ident, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((ident, len(links[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def found(frame, **options):
    out = subspace_join.linked_vectors(frame, **options).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return sorted([(r.vec_id, r.n_links, r.component_id) for r in out], key=str)


def sample(n, size, seed, noise):
    random = np.random.default_rng(seed)
    centres = random.standard_normal((n // 12 + 1, size))
    return [
        (int(i), (centres[random.integers(len(centres))] + noise * random.standard_normal(size)).astype(np.float32).tolist(), int(random.integers(3)))
        for i in random.permutation(n)
    ]


def test_matches_brute_force(spark):
    rows = sample(400, 24, 1, 0.12) + [(1000 + i, *r[1:]) for i, r in enumerate(sample(60, 5, 2, 0.1))]
    expected = brute(rows)
    assert sum(n for _, n, _ in expected) > 100
    assert found(vectors(spark, rows)) == expected


def test_crowded_cells_are_dealt_out(spark):
    random = np.random.default_rng(3)
    base = random.standard_normal(16)
    rows = [(i, (base + 0.05 * random.standard_normal(16)).astype(np.float32).tolist(), 1) for i in range(150)]
    assert found(vectors(spark, rows), chunk_rows=20) == brute(rows)


def test_rows_that_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 7), (2, v, 7), (2, v, 7), (3, [2.0, 4.0, 6.0], 7), (4, v, None), (5, None, 7), (6, [], 7),
        (7, [0.0, 0.0, 0.0], 7), (8, [1.0, None, 3.0], 7), (9, [1.0, float("nan"), 3.0], 7),
        (10, [1.0, float("inf"), 3.0], 7), (None, v, 7), (11, [1.0, 2.0], 7), (12, v, 8), (13, [-0.0, 1.0, 0.0], 7), (14, [0.0, 1.0, 0.0], 7),
    ]
    assert found(vectors(spark, rows)) == brute(rows)
    assert found(vectors(spark, rows).limit(0)) == []


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3), (5, 6)]
    out = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert out == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_disk_is_a_fraction_of_the_input(spark):
    random = np.random.default_rng(4)
    rows = [(i, random.standard_normal(64).astype(np.float32).tolist(), i % 2) for i in range(3000)]
    folder = Path(urlparse(shared_folder(spark)).path)
    before = set(folder.rglob("*.parquet"))
    assert all(n == 0 for _, n, _ in found(vectors(spark, rows).repartition(2)))
    written = sum(p.stat().st_size for p in set(folder.rglob("*.parquet")) - before)
    assert written < 0.5 * 3000 * 64 * 4


@pytest.mark.parametrize("n, chunk_rows", [(100, 100), (100, 60), (100, 40), (100, 30), (100, 10), (5, 1)])
def test_each_two_chunks_meet_in_one_task(spark, n, chunk_rows):
    codes = spark.range(n).selectExpr("id AS class_id", "1L AS weight", "1 AS label", "2 AS size", "encode(cast(id AS string), 'UTF-8') AS code")
    dealt = subspace_join._dealt(codes, codes, chunk_rows).collect()
    chunks = -(-n // chunk_rows)
    assert len(dealt) <= n * (chunks // 2 + 1)
    own = {r.class_id: r.home for r in dealt if not r.guest}
    assert len(own) == n == sum(not r.guest for r in dealt)
    met = [{own[r.class_id], r.home} for r in dealt if r.guest]
    there = {(r.home, own[r.class_id]) for r in dealt if r.guest}
    assert all(len(pair) == 2 for pair in met) and all((b, a) not in there for a, b in there)
    assert {frozenset(pair) for pair in met} >= {frozenset((a, b)) for a in own.values() for b in own.values() if a != b}


def test_chunks_without_vectors(spark):
    rows = sample(40, 8, 6, 0.05)
    assert found(vectors(spark, rows), chunk_rows=1) == brute(rows)


def test_repeated_ids_and_vectors_across_chunks(spark):
    rows = [(i, v, 1) for i, v, _ in sample(90, 6, 7, 0.05)]
    rows += [(1000 + k, rows[k % 5][1], 1) for k in range(40)] + rows[:7]
    assert found(vectors(spark, rows), chunk_rows=25) == brute(rows)


@pytest.mark.parametrize("size, noise", [(64, 0.1), (64, 0.14), (24, 0.13), (5, 0.1), (2, 0.05), (1, 0.1)])
def test_region_matches_brute_force(size, noise):
    """Held vectors and guests, of which very many are within reach of one; links by weight."""
    random = np.random.default_rng(size)
    x = random.standard_normal((900, size))
    x[:300] = x[0] / np.linalg.norm(x[0]) + noise / np.sqrt(size) * random.standard_normal((300, size))
    x[300:400] = x[500:600] + 0.1 * random.standard_normal((100, size))
    x = random.permutation(x)
    codes = np.rint(x / np.linalg.norm(x, axis=1, keepdims=True) * SCALE).astype(np.int16)
    ids, weights = random.permutation(900).astype(np.int64), random.integers(1, 4, 900)
    reach = Reach.of(size, 0.98, 8)
    apart = ((codes[:, None].astype(np.int64) - codes[None]) ** 2).sum(axis=2)
    np.fill_diagonal(apart, np.iinfo(np.int64).max)
    linked, unsure = apart <= reach.sure, (apart > reach.sure) & (apart <= reach.most)

    first, second = (Region(ids[s], weights[s], codes[s], 0.98, 8) for s in (slice(0, 500), slice(500, 900)))
    assert size < 24 or len(first.heads)
    counts, ends, close = np.zeros(900, np.int64), set(), []
    for links in (first.own(), second.own(), first.guests(ids[500:], weights[500:], codes[500:])):
        a, b, n, ca, cb = links.found()
        np.add.at(counts, a, n)
        ends |= set(zip(a.tolist(), b.tolist(), strict=True))
        close += [tuple(sorted(pair)) for pair in zip(ca.tolist(), cb.tolist(), strict=True)]
    assert (counts[ids] == linked @ weights).all()
    assert sorted(close) == sorted(tuple(sorted((int(ids[i]), int(ids[j])))) for i, j in zip(*np.nonzero(np.triu(unsure)), strict=True))

    def parts(edges):
        names = list(range(900))
        while True:
            new = list(names)
            for a, b in edges:
                new[a] = new[b] = min(new[a], new[b])
            if new == names:
                return names
            names = new

    assert parts(ends) == parts([(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(linked), strict=True)])
