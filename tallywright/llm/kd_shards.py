"""Shards of near-equal bytes by a k-d tree over document metadata.

The tree is split node by node at the distributed weighted median of the dimension
in which the node is widest (relative to the whole table): size in bytes, length in
characters, or the checksum of the text. All of these follow from the text alone,
so copies of a text are one point and share a shard. Only where a point is too
heavy for a fair cut (a group of copies larger than a shard) is a node cut along a
hash of the document id, which deals the copies out.

A level costs a few aggregations over a narrow table of numbers, for all its nodes
at once: minima and maxima, then histograms whose bins narrow down on each median.
The driver sees one row per node and bin, never rows of documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tallywright.llm.common import stored

ROW_BYTES = 16  # what a row weighs besides its text
BINS = 1024
#: A histogram bin lighter than this share of a shard is not narrowed down further.
FINE = 0.002
#: A cut may miss its median by this share of a shard before another dimension is tried.
TOLERANCE = 0.01
#: Rows of a shard that one task numbers.
SLOT_ROWS = 50_000

_DIMENSIONS = ("size", "chars", "text_crc32", "spread")


@dataclass
class Node:
    shards: int
    first: int
    bytes: int = 0
    ranges: dict = field(default_factory=dict)
    dimension: str | None = None
    cut: int = 0
    below: Node | None = None
    above: Node | None = None


@dataclass
class _Search:
    """The search for one node's median along one dimension."""

    node: Node
    dimension: str
    low: int
    high: int
    target: float
    left: int = 0

    @property
    def width(self) -> int:
        return (self.high - self.low) // BINS + 1

    def narrow(self, bins: dict[int, int], enough: float) -> tuple[int, float] | None:
        """Takes one histogram; the cut (largest value below it) and its error once it is found."""
        at, weight = 0, 0
        for at in sorted(bins):
            weight = bins[at]
            if self.left + weight >= self.target:
                break
            self.left += weight
        width, low = self.width, self.low + at * self.width
        self.low, self.high = low, min(self.high, low + width - 1)
        if width > 1 and weight > enough:
            return None
        before, after = abs(self.target - self.left), abs(self.left + weight - self.target)
        return (self.low - 1, before) if before <= after else (self.high, after)


def metadata(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document; a null text weighs as an empty one."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.char_length(body).cast("long").alias("chars"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.col(key)), 20).alias("spread"),
    )


def _place(node: Node, leaf) -> Column:
    if node.below is None:
        return F.lit(leaf(node))
    return F.when(F.col(node.dimension) <= node.cut, _place(node.below, leaf)).otherwise(_place(node.above, leaf))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.below is None else _leaves(node.below) + _leaves(node.above)


def _measure(rows: DataFrame, root: Node, nodes: list[Node]) -> None:
    """Bytes and ranges of the nodes that are still to be split."""
    found = (
        rows.withColumn("node", _place(root, lambda n: n.first))
        .groupBy("node")
        .agg(F.sum("size"), *[f(d) for d in _DIMENSIONS for f in (F.min, F.max)])
        .collect()
    )
    by_first = {row[0]: row for row in found}
    for node in nodes:
        if row := by_first.get(node.first):
            node.bytes = row[1]
            node.ranges = {d: (row[2 + 2 * i], row[3 + 2 * i]) for i, d in enumerate(_DIMENSIONS)}


def _histograms(rows: DataFrame, root: Node, searches: list[_Search]) -> dict[int, dict[int, int]]:
    """Bytes per node and bin."""
    spark = rows.sparkSession
    asked = spark.createDataFrame(
        [(s.node.first, s.dimension, s.low, s.high, s.width) for s in searches],
        "node int, dimension string, low long, high long, width long",
    )
    value = F.coalesce(*[F.when(F.col("dimension") == d, F.col(d)) for d in _DIMENSIONS])
    found = (
        rows.withColumn("node", _place(root, lambda n: n.first))
        .join(F.broadcast(asked), "node")  # one row per node of the level
        .withColumn("value", value)
        .filter("value BETWEEN low AND high")
        .groupBy("node", F.expr("(value - low) DIV width").alias("bin"))
        .agg(F.sum("size").alias("bytes"))
        .collect()
    )
    bins: dict[int, dict[int, int]] = {}
    for node, at, size in found:
        bins.setdefault(node, {})[at] = size
    return bins


def _cuts(rows: DataFrame, root: Node, nodes: list[Node], shard_bytes: float) -> None:
    """Finds the cut of each node: along its widest dimension that allows a fair one, else along the fairest."""
    whole = root.ranges

    def order(node: Node) -> list[str]:
        share = lambda d: (node.ranges[d][1] - node.ranges[d][0]) / max(1, whole[d][1] - whole[d][0])
        return sorted(_DIMENSIONS[:-1], key=share, reverse=True) + [_DIMENSIONS[-1]]

    def search(node: Node, dimension: str) -> _Search:
        low, high = node.ranges[dimension]
        return _Search(node, dimension, low, high, node.bytes * (node.shards // 2) / node.shards)

    left = {node.first: order(node) for node in nodes}
    best: dict[int, tuple[float, str, int]] = {}
    open_ = [search(node, left[node.first].pop(0)) for node in nodes]
    while open_:
        bins = _histograms(rows, root, open_)
        going = []
        for s in open_:
            done = s.narrow(bins.get(s.node.first, {}), FINE * shard_bytes)
            if done is None:
                going.append(s)
                continue
            cut, error = done
            if s.node.first not in best or error < best[s.node.first][0]:
                best[s.node.first] = (error, s.dimension, cut)
            if error > TOLERANCE * shard_bytes and left[s.node.first]:
                going.append(search(s.node, left[s.node.first].pop(0)))
        open_ = going
    for node in nodes:
        _, node.dimension, node.cut = best[node.first]


def grow(rows: DataFrame, shards: int) -> Node:
    """The tree over rows of `metadata`, with `shards` leaves. Nodes without rows are cut anywhere."""
    root = Node(shards, 0)
    while nodes := [n for n in _leaves(root) if n.shards > 1]:
        _measure(rows, root, nodes)
        filled = [n for n in nodes if n.ranges]
        if filled:
            _cuts(rows, root, filled, root.bytes / shards)
        for node in nodes:
            node.dimension = node.dimension or _DIMENSIONS[0]
            half = node.shards // 2
            node.below, node.above = Node(half, node.first), Node(node.shards - half, node.first + half)
    return root


def kd_shards(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of `docs`.

    Either the number of shards is given or `target_bytes`, from which it follows. Slots
    count from 0 within a shard without gaps. Null texts and ids are taken like any other
    row, repeated rows each get a slot, and an empty table gives no rows.
    """
    rows = stored(metadata(docs, key, text), "kd-metadata")
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    placed = rows.withColumn("shard", _place(grow(rows, shards), lambda n: n.first).cast(T.IntegerType()))
    most = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, math.ceil(most / SLOT_ROWS))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return (
        placed.withColumn("within", within)
        .join(offsets, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("within") - 1).alias("slot"))
    )
