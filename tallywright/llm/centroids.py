"""Clusters vectors around centroids; the nearest centroid is found by the threshold algorithm.

Vectors are integers from the start (floor of scale times component), so that distances,
sums and centroids are exact and do not depend on the order of rows. Every dimension has
a list of the centroids sorted by their value there. A vector walks all lists outward from
its own value, a step in each list at a time; a centroid seen for the first time has its
exact distance computed. No centroid that is still unseen can be nearer than the sum of the
squared distances at the frontiers, so the walk ends once that sum is strictly greater than
the best exact distance: at a tie an unseen centroid of a smaller number might still win.

A round is one pass in which tasks return sums per centroid; on the driver there are only
the centroids (k times dimensions).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import stored

SCALE = 256
LARGEST = 1 << 27  # squared distances of integers below it fit 64 bits in up to 64 dimensions
_ROWS = 2048
_FAR = np.int64(1) << 40


@dataclass(frozen=True)
class Clusters:
    """`assigned` (id column, cluster, distance) and the centroids as lists of integers, by number."""

    assigned: DataFrame
    centroids: list[list[int]]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid, the smaller number at ties."""
    n, k = len(vectors), len(centroids)
    dims = np.arange(centroids.shape[1])
    order = np.argsort(centroids, axis=0, kind="stable")
    # One value beyond each end of a list, farther than any other.
    values = np.vstack([np.full_like(dims, -_FAR), np.take_along_axis(centroids, order, axis=0), np.full_like(dims, _FAR)])
    order = np.vstack([order[:1], order, order[-1:]])
    right = np.stack([np.searchsorted(values[:, d], vectors[:, d]) for d in dims], axis=1)
    left = right - 1
    best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    seen = np.zeros((n, k), bool)
    walking = np.arange(n)
    for _ in range(k):
        x, at_left, at_right = vectors[walking], left[walking], right[walking]
        below, above = x - values[at_left, dims], values[at_right, dims] - x
        down = below <= above
        met = order[np.where(down, at_left, at_right), dims]
        left[walking] -= down
        right[walking] += ~down

        known = seen[walking]
        now = known.copy()
        now[np.arange(len(walking))[:, None], met] = True
        row, fresh = np.nonzero(now & ~known)
        seen[walking] = now
        distance = ((x[row] - centroids[fresh]) ** 2).sum(axis=1)
        # Pairs come by row and by number, so the first least one of a row has the smallest number.
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        if len(starts):
            least = np.minimum.reduceat(distance, starts)
            hit = np.flatnonzero(distance == np.repeat(least, np.diff(np.append(starts, len(row)))))
            hit = hit[np.diff(row[hit], prepend=-1) > 0]
            at = walking[row[hit]]
            better = (least < best[at]) | ((least == best[at]) & (fresh[hit] < number[at]))
            best[at[better]], number[at[better]] = least[better], fresh[hit][better]

        frontier = (np.minimum(below, above) ** 2).sum(axis=1)
        walking = walking[frontier <= best[walking]]
        if not len(walking):
            break
    return number, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def _assigned(vectors: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """(id, cluster, distance) of every vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = np.array(centroids, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                number, distance = nearest(_matrix(part.column(1), dims), middle)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"]
                )

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "v").mapInArrow(work, f"id {kind}, cluster int, distance long")


def _sums(vectors: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """(cluster, dim, total, n): componentwise sums of the vectors nearest to each centroid; a row per task before they combine."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = np.array(centroids, np.int64)
        total, n = np.zeros((len(middle), dims), np.int64), np.zeros(len(middle), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = _matrix(batch.slice(start, _ROWS).column(0), dims)
                number, _ = nearest(part, middle)
                np.add.at(total, number, part)
                n += np.bincount(number, minlength=len(middle))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(total[some].tolist(), pa.list_(pa.int64())), pa.array(n[some])],
            ["cluster", "total", "n"],
        )

    by_task = vectors.select("v").mapInArrow(work, "cluster int, total array<long>, n long")
    return (
        by_task.select("cluster", "n", F.posexplode("total").alias("dim", "total"))
        .groupBy("cluster", "dim")
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    )


def usable(vector: Column, dims: int, scale: int = SCALE) -> Column:
    """Whether a vector has `dims` components, none null, non-finite or too large."""
    fits = lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST // scale, F.lit(False))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, fits), F.lit(False))


def integers(vectors: DataFrame, dims: int, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): the usable vectors, each component as floor(scale * component)."""
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("int"))
    return vectors.filter(usable(F.col(vector), dims, scale)).select(F.col(key).alias("id"), whole.alias("v"))


def clusters(
    vectors: DataFrame, k: int, rounds: int, dims: int, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, seed: int = 2
) -> Clusters:
    """Clusters around `k` centroids after `rounds` rounds and a last assignment.

    Centroids start as the k vectors with the least SHA-256 of "seed:key", in that order (null
    keys last, repeated keys by their vectors). A round replaces every centroid that has vectors
    by their componentwise floor(sum / count). Vectors that are null, of another length, or hold
    null, NaN or infinite components are left out, and so are those with a component of 2**27 /
    scale or more, whose squared distances 64 bits cannot be sure to hold. Fewer than k vectors
    give as many centroids; an empty table gives none and no rows.
    """
    kept = stored(integers(vectors, dims, key, vector, scale), "integer-vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()
    centroids = [list(row["v"]) for row in first]
    for _ in range(rounds if centroids else 0):
        moved = [list(c) for c in centroids]
        for row in _sums(kept, centroids, dims).collect():  # k times dims rows
            moved[row["cluster"]][row["dim"]] = int(row["total"]) // int(row["n"])
        centroids = moved
    if not centroids:
        return Clusters(kept.select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [])
    return Clusters(stored(_assigned(kept, centroids, dims), "assigned-vectors").withColumnRenamed("id", key), centroids)


def with_inertia(found: Clusters) -> DataFrame:
    """The assigned vectors with the sum of distances of their cluster and of all, and a digest of their centroid."""
    rows = found.assigned
    by_cluster = {
        r["cluster"]: int(r["total"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    }
    whole = sum(by_cluster.values())
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = [(i, by_cluster.get(i, 0), whole, digest(c)) for i, c in enumerate(found.centroids)]
    table = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select(*rows.columns, "cluster_inertia", "inertia", "centroid_sha256")
