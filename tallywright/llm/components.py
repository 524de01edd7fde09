"""Connected components of a link table, by alternating stars.

Every pass links each node to the smallest node that it sees, first from the
larger neighbours' side, then from the smaller ones'. Passes are logarithmic in
the diameter in practice. Minima combine before they shuffle, and each join has
an exchange on both sides, so that adaptive execution can split a node with very
many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import stored


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node either has one link to a smaller node, or links from larger ones only."""
    ends = edges.selectExpr("inline(array(struct(u AS node, 1 AS up, 0 AS down), struct(v AS node, 0 AS up, 1 AS down)))")
    sides = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sides.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def _larger_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-minima")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _smaller_star(edges: DataFrame) -> DataFrame:
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "star-minima")
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def oriented(links: DataFrame) -> DataFrame:
    """(u, v) with u > v: the links (a, b), each once; loops and links with a null end are left out."""
    return links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def labels(edges: DataFrame) -> DataFrame:
    """(node, component): every node of (u, v) with the smallest node that it is linked to, itself included."""
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return nodes.union(heads).groupBy("node").agg(F.min("component").alias("component"))


def jumped(found: DataFrame) -> DataFrame:
    """`labels` with every label replaced by the label of the node that it names."""
    further = found.select(F.col("node").alias("component"), F.col("component").alias("next"))
    return found.join(further.hint("merge"), "component").select("node", F.col("next").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in `links` (a, b); a component is named by its smallest node.

    Loops and links with a null end are ignored, repeated links count once, and a
    table without links gives no rows.
    """
    edges = stored(oriented(links), "links")
    while not _are_stars(edges):
        edges = stored(_smaller_star(stored(_larger_star(edges), "star")), "star")
    return labels(edges)
