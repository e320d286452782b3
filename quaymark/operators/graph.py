"""Connected components by alternating star contraction, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.sources.shared import stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for each node of ``edges``; the component is its smallest node.

    Each round joins the larger neighbours of every node to its smallest one, then the smaller
    neighbours; the number of rounds grows with the logarithm of the number of nodes, and the number
    of edges does not grow. Either half of a round is written to the shared folder, so that a lost executor
    costs no earlier one, and the driver plans few joins at a time. Self loops make a node known; null ends are ignored.
    """
    pairs = stored(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null"), "components-pairs")
    nodes = stored(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "components-nodes")
    current = stored(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    mark = _mark(current)
    while mark[0]:
        current = stored(_small_star(stored(_large_star(current), "components-large")), "components")
        last, mark = mark, _mark(current)
        if mark == last:
            break
    found = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the smallest of them."""
    down = edges.where("u > v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    # a node has one row with its smallest neighbour, which joins the node itself; the other rows join the neighbour
    moved = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return down.join(least, "u").select(moved.alias("u"), F.col("m").alias("v")).distinct()
