"""All pairs of vectors of one label with cosine at or above a threshold, by subspace pigeonholes.

For unit vectors a cosine of t is a squared distance of 2 - 2t. After a fixed random
rotation each vector is cut into blocks; a pair within that squared distance is
within its proportional share of it in at least one block. So each block is joined by
range on its own, and a pair that meets in several blocks counts in the first of them
only (`block_ranges`). No pair is ever written: a task returns, per vector, the number
of links and one link towards the smallest id that it reaches there.

A task joins the vectors of one label, so that a vector is sent once, and not once for
each block. Labels of very many vectors are dealt out in chunks: a chunk's task holds it
and has about half of the other chunks streamed past, so that each two chunks meet once.

Equal vectors are one class with a weight before any of this. What is sent are rotated
coordinates in 16 bits; pairs too close to the threshold for these (a handful) are
decided by the cosine of the vectors themselves in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm import bitmaps
from tallywright.llm.block_ranges import SCALE, Links, Region
from tallywright.llm.common import Batches, giving_back, stored
from tallywright.llm.components import components

BLOCKS = 8
#: The most vectors of a chunk, and of the others that are compared with it at a time; the most bytes of these.
CHUNK_ROWS, GUEST_ROWS, CHUNK_BYTES = 500_000, 250_000, 64_000_000
#: Labels of over so many vectors are dealt out in up to so many chunks before memory asks for it.
SPREAD_ROWS, SPREAD = 25_000, 3

_CODES = "class_id long, weight long, label int, size int, code binary"
_FOUND = "a long, b long, links long"


def _usable(vector: str) -> Column:
    """Not null, without null or non-finite components, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(size: int) -> np.ndarray:
    """A fixed random rotation of `size` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _codes(vectors: DataFrame) -> DataFrame:
    """Each class with its rotated unit vector in whole numbers."""

    def code(batches: Batches) -> Batches:
        rotations: dict[int, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                vector = batch.column("vector")
                sizes = vector.value_lengths().to_numpy()
                first = np.concatenate([[0], np.cumsum(sizes)])
                values = vector.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    x = values[first[at][:, None] + np.arange(size)]
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    if size not in rotations:
                        rotations = {size: rotation(int(size))}
                    found = np.rint(x @ rotations[size] * SCALE).astype(np.int16)
                    ends = pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * np.int32(2 * size))
                    chosen = batch.select(["class_id", "weight", "label"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [*chosen.columns, pa.array(np.full(len(at), size, np.int32)), pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(found)])],
                        ["class_id", "weight", "label", "size", "code"],
                    )

    return vectors.select("class_id", "weight", "label", "vector").mapInArrow(code, _CODES)


def _dealt(codes: DataFrame, classes: DataFrame, chunk_rows: int) -> DataFrame:
    """Deals vectors out to the tasks that join them: adds home, the chunk that the task holds, and guest.

    A vector is no guest where its own chunk is held. Of each two chunks one is a guest of the other.
    """
    most = F.least(F.lit(chunk_rows), F.greatest(F.lit(1), F.floor(CHUNK_BYTES / (2 * F.col("size")))))
    n = F.col("n")
    crowded = stored(
        classes.groupBy("label", "size")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("chunks", F.greatest(F.ceil(n / most), F.least(F.lit(SPREAD), F.ceil(n / SPREAD_ROWS))).cast("int"))
        .filter("chunks > 1")
        .select("label", "size", "chunks"),
        "crowded-labels",
    )
    steps = F.expr("sequence(0, cast((chunks - 1) div 2 as int) + if(chunks % 2 = 0 and chunk >= chunks / 2, 1, 0))")
    return (
        codes.join(F.broadcast(crowded), ["label", "size"], "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("chunk", F.pmod(F.xxhash64("class_id", "code"), "chunks").cast("int"))
        .withColumn("step", F.explode(steps))
        .select("label", "size", F.expr("pmod(chunk - step, chunks)").alias("home"), (F.col("step") > 0).alias("guest"), "class_id", "weight", "code")
    )


def _found(links: Links) -> pa.RecordBatch:
    ids, least, counts, a, b = links.found()
    counts = pa.array(np.concatenate([counts, np.zeros(len(a), np.int64)]), mask=np.arange(len(ids) + len(a)) >= len(ids))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, a])), pa.array(np.concatenate([least, b])), counts], ["a", "b", "links"])


_Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, ...], bool, _Rows]]:
    """(task's key, whether they are guests, (ids, weights, codes)) of the runs of rows that belong together."""
    if not batch.num_rows:
        return
    key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "size", "home", "guest")], axis=1)
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    for start, end in zip(starts, [*starts[1:], len(key)], strict=True):
        rows, size = batch.slice(start, end - start), int(key[start, 1])
        code = rows.column("code")
        ends = np.frombuffer(code.buffers()[1], np.int32)[code.offset : code.offset + len(code) + 1]
        codes = np.frombuffer(code.buffers()[2], np.int16)[ends[0] // 2 : ends[-1] // 2].reshape(-1, size)
        ids, weights = (rows.column(c).to_numpy() for c in ("class_id", "weight"))
        yield tuple(map(int, key[start, :3])), bool(key[start, 3]), (ids.copy(), weights.copy(), codes.copy())


def _gathered(parts: list[_Rows]) -> _Rows:
    rows = tuple(np.concatenate([part[i] for part in parts]) for i in range(3))
    parts.clear()
    return rows


def _links(threshold: float, blocks: int) -> Callable[[Batches], Batches]:
    """Joins the vectors of each task; the held ones come before the guests."""

    def join(batches: Batches) -> Batches:
        at: tuple[int, ...] | None = None
        region: Region | None = None
        waiting: list[_Rows] = []

        def held() -> Batches:
            """Joins what waits with what is held, or else holds it."""
            nonlocal region
            if not waiting:
                return
            if region is None:
                region = Region(*_gathered(waiting), threshold, blocks)
                found = _found(region.own())
            else:
                found = _found(region.guests(*_gathered(waiting)))
            if found.num_rows:
                yield found

        for batch in batches:
            for key, guest, rows in _runs(batch):
                if key != at:
                    yield from held()
                    at, region = key, None
                if guest and region is None:
                    yield from held()
                    if region is None:  # a chunk without vectors
                        continue
                waiting.append(rows)
                if region is not None and sum(len(ids) for ids, _, _ in waiting) >= min(GUEST_ROWS, CHUNK_BYTES // (4 * key[1])):
                    yield from held()
        yield from held()

    return join


def _close_links(members: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, wa, wb): those of the pairs whose cosine in double precision reaches the threshold, with both weights."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().select(F.xxhash64("id").alias("hashed"))
    needed = bitmaps.marked(members.withColumn("hashed", F.xxhash64("class_id")), "hashed", ends)
    needed = stored(needed.select("class_id", "weight", "vector"), "close-vectors")
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    side = lambda c: needed.select(F.col("class_id").alias(c), double("vector").alias(f"v{c}"), F.col("weight").alias(f"w{c}"))
    cosine = dot("va", "vb") / (F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb")))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(cosine >= threshold).select("a", "b", "wa", "wb")


def linked_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    blocks: int = BLOCKS,
    chunk_rows: int = CHUNK_ROWS,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors`.

    Rows link where labels are equal and not null and the cosine reaches the threshold.
    Null or zero vectors and those with null or non-finite components link with nothing, nor
    do rows without an id or vectors of different lengths; these are components of their own.
    Repeated rows are vectors of their own that link with each other. An empty table gives
    no rows.
    """
    ids = F.col(key).cast("long")
    rows = vectors.select(ids.alias("vec_id"), F.col(label).cast("int").alias("label"), F.col(vector).alias("vector"))
    good = _usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    k1, k2 = F.xxhash64("label", "vector"), F.xxhash64("vector", F.lit(1), "label")
    keyed = rows.select("vec_id", F.when(good, k1).alias("k1"), F.when(good, k2).alias("k2"))
    able = rows.filter(good).select("vec_id", "label", "vector", k1.alias("k1"), k2.alias("k2"))
    a_class = F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label")
    classes = stored(
        able.select("vec_id", "label", F.size("vector").alias("size"), "k1", "k2").groupBy("k1", "k2").agg(*a_class, F.first("size").alias("size")),
        "vector-classes",
    )
    # Only vectors that may be repeated are brought together; the others are classes as they are.
    again = bitmaps.perhaps_in(able, "k1", stored(bitmaps.parts(classes.filter("weight > 1").select("k1"), "k1"), "repeated"), "again")
    each = again.filter("NOT again").select(F.col("vec_id").alias("class_id"), F.lit(1).cast("long").alias("weight"), "label", "vector")
    repeated = again.filter("again").groupBy("k1", "k2").agg(*a_class, F.first("vector").alias("vector")).drop("k1", "k2")
    members = each.union(stored(repeated, "repeated-vectors"))

    place = ["label", "size", "home"]
    visits = _dealt(_codes(members), classes, chunk_rows).repartition(*place).sortWithinPartitions(*place, "guest")
    found = stored(visits.mapInArrow(giving_back(_links(threshold, blocks)), _FOUND), "vector-links")

    sure = found.filter("links IS NOT NULL")
    close = stored(_close_links(members, found.filter("links IS NULL").select("a", "b"), threshold), "close-links")
    counts = (
        sure.select(F.col("a").alias("class_id"), "links")
        .union(close.select("a", F.col("wb")))
        .union(close.select("b", F.col("wa")))
        .groupBy("class_id")
        .agg(F.sum("links").alias("others"))
    )
    groups = components(sure.select("a", "b").union(close.select("a", "b")))
    named = (
        classes.select("k1", "k2", "class_id", "weight")
        .join(counts, "class_id", "left")
        .join(groups.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
        .select("k1", "k2", "class_id", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "class_id").alias("root"))
    )
    named = stored(named.filter("n > 0 OR root <> class_id").drop("class_id"), "vector-groups")
    component = F.coalesce("root", "vec_id")
    return keyed.join(named, ["k1", "k2"], "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
