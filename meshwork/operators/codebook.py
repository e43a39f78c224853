"""A codebook that grows: anchors chosen among prints so that every print is near one and no two anchors are near each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..sources.scratch import Scratch
from .search import TIGHT, near_pairs, within


def near_links(prints: DataFrame, most: int, recall: float) -> DataFrame:
    """(a, b, distance) of different prints (id, words) at most `most` bits apart, both ways round."""
    met = near_pairs(prints, prints, most, recall) if most <= TIGHT and recall < 1 else within(prints, prints, most)
    return met.where("query_id <> id").select(F.col("query_id").alias("a"), F.col("id").alias("b"), "distance")


def leaders(nodes: DataFrame, links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """The ids of nodes (id) that the greedy choice takes which goes by a random order and skips neighbours of what it took:
    a maximal independent set of links (a, b).

    All nodes that come before all of their undecided neighbours are taken at once, and their neighbours are out. In random
    order the rounds grow with the logarithm of the nodes. Each is written, so a lost executor costs one of them.
    """
    order = lambda c: F.struct(F.xxhash64(c, F.lit(29)), F.col(c))
    open_ = scratch.written(nodes.select("id").distinct(), "open")
    links = scratch.written(links.where(order("a") > order("b")).select("a", "b"), "links")  # b comes before a
    taken: list[DataFrame] = []
    for _ in range(most_rounds):
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, taken) if taken else open_
        own = scratch.written(open_.join(links.select(F.col("a").alias("id")).distinct(), "id", "left_anti"), "taken", keep=True)
        taken.append(own)
        out = links.join(own.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        open_ = scratch.written(open_.join(own, "id", "left_anti").join(out, "id", "left_anti"), "open", keep=True)
        left = links.join(open_.select(F.col("id").alias("a")), "a", "left_semi").join(open_.select(F.col("id").alias("b")), "b", "left_semi")
        links = scratch.written(left, "links")
    raise RuntimeError(f"leaders are not settled after {most_rounds} rounds")


def grow_codebook(prints: DataFrame, most: int, anchors: DataFrame | None = None, recall: float = 0.9999, words: str = "words") -> tuple[DataFrame, DataFrame]:
    """(anchors, assigned): anchors (id, words) of which no two are at most `most` bits apart, and for each print (id, anchor,
    distance) its nearest anchor, at most `most` bits away, ties to the lesser one.

    Given anchors stay, and new ones are created among the prints that are near none of them, by leader clustering in a
    random order. Equal prints are one, so copies are never compared with one another. Null prints are left out. Bounds
    of at most TIGHT bits are searched by sampled bits, each pair with probability `recall`; wider ones by brute force.
    """
    scratch = Scratch(prints.sparkSession)
    with scratch:
        own = prints.where(F.col(words).isNotNull()).select("id", F.col(words).alias("words")).withColumn("print", F.md5(bits.to_binary(F.col("words"))))
        own = scratch.written(own, "prints", keep=True)
        distinct = scratch.written(own.groupBy("print").agg(F.min("id").alias("id"), F.first("words").alias("words")), "distinct", keep=True)
        known = distinct.select("id", "words").limit(0) if anchors is None else scratch.written(anchors.where(F.col(words).isNotNull()).select("id", F.col(words).alias("words")), "anchors", keep=True)
        free = distinct.select("id", "words")
        if anchors is not None:
            met = near_pairs(free, known, most, recall) if most <= TIGHT and recall < 1 else within(free, known, most)
            free = scratch.written(free.join(met.select(F.col("query_id").alias("id")).distinct(), "id", "left_anti"), "free", keep=True)
        chosen = leaders(free, near_links(free, most, recall), scratch)
        book = scratch.written(known.unionByName(free.join(chosen, "id", "left_semi").select("id", "words")), "book", keep=True)
        near = near_pairs(distinct.select("id", "words"), book, most, recall) if most <= TIGHT and recall < 1 else within(distinct.select("id", "words"), book, most)
        best = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        nearest = near.withColumn("_n", best).where("_n = 1").select(F.col("query_id").alias("least"), F.col("id").alias("anchor"), "distance")
        members = own.select("id", "print").join(distinct.select("print", F.col("id").alias("least")), "print")
        assigned = scratch.written(members.join(nearest, "least").select("id", "anchor", "distance"), "assigned", keep=True)
    return book, assigned
