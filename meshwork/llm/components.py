"""Connected components by distributed union-find, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def star_step(edges: DataFrame, small: bool) -> DataFrame:
    """One star operation on (u, v) rows, u > v. Large: larger neighbours of a node hang on its least neighbour; small: the
    lesser ones and the node do. A hub's neighbours are never gathered: its minimum is aggregated and joined."""
    if small:
        around = edges
    else:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    if small:
        own = least.select("u", F.col("m").alias("v"))
        moved = around.join(least, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(own).distinct()
    hung = around.join(least, "u").where(F.col("v") > F.col("u"))
    return hung.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def connected_components(edges: DataFrame, left: str, right: str, most_rounds: int = 40) -> DataFrame:
    """(node, component) of every node with an edge to another: component is the least node that can be reached.

    Null ends and loops are dropped, repeated edges count once, no edges give no rows. Every round is written to the
    shared folder, so lost executors redo one round at most. The number of rounds grows with the logarithm of the
    longest chain; a graph that hasn't settled after most_rounds is an error, never a partial answer.
    """
    a, b = F.col(left), F.col(right)
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    with Scratch(edges.sparkSession) as scratch:
        now = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
        now = scratch.written(now, "edges")
        seen = mark(now)
        for _ in range(most_rounds):
            now = scratch.written(star_step(star_step(now, small=False), small=True), "edges")
            if (new := mark(now)) == seen:
                nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
                nodes = nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
                return scratch.written(nodes, "components", keep=True)
            seen = new
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")
