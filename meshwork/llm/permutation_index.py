"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order. Each block of vectors holds an inverted file per pivot: the
vectors that have the pivot among their nearest, and at which rank. A query walks the files of its own nearest pivots,
adds up what each met vector saves of the footrule distance, keeps the share of them with the smallest distance and
reranks these by the exact inner product; vectors that it doesn't meet are never scored. Blocks are independent tasks,
so a vector that a third of all rows repeat is spread over all blocks like any other, and no task holds more than one
block of vectors and one of queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import task_count

NEIGHBOURS = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id long, v array<double>), without vectors that are null, empty, zero, or hold null or non-finite parts."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .where(~bad & F.exists(v, lambda x: x != 0.0))
    )


def choose_pivots(vectors: DataFrame, n_pivots: int) -> np.ndarray:
    """A bounded sample of distinct vectors of the most frequent dimension as pivots: those whose id hashes lowest, the same on
    every run."""
    dims = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return np.zeros((0, 1))
    rows = vectors.where(F.size("v") == dims["d"]).select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(2 * n_pivots).collect()
    return np.array(list(dict.fromkeys(tuple(r["v"]) for r in rows))[:n_pivots], dtype="f8")


def nearest_pivots(v: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The first `length` pivots of each row's permutation."""
    length = min(length, len(pivots))
    near = v @ pivots.T
    top = np.argpartition(-near, length - 1, axis=1)[:, :length]
    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1)


class PivotFiles:
    """The inverted files of one block: of each pivot the rows that have it among their `posted` nearest, and its ranks."""

    def __init__(self, v: np.ndarray, pivots: np.ndarray, posted: int):
        permutations = nearest_pivots(v, pivots, posted)
        self.length = permutations.shape[1]
        pivot, row = permutations.ravel(), np.repeat(np.arange(len(v)), self.length)
        order = np.argsort(pivot, kind="stable")
        self.rows, self.ranks = row[order], np.tile(np.arange(self.length), len(v))[order]
        self.bounds = np.searchsorted(pivot[order], np.arange(len(pivots) + 1))
        self.n_rows = len(v)

    def met(self, permutation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, saved): the rows that share a pivot with a query's permutation, and by how much that shortens the footrule.

        With pivots that a side lacks at rank `length` there, the distance without any shared pivot is the same for all;
        one at ranks r and q saves 2 * (length - max(r, q)), since |r - q| replaces (length - r) + (length - q).
        """
        length = max(self.length, len(permutation))
        saved = np.zeros(self.n_rows, dtype=np.int64)
        for q, pivot in enumerate(permutation):
            own = slice(self.bounds[pivot], self.bounds[pivot + 1])
            saved[self.rows[own]] += 2 * (length - np.maximum(self.ranks[own], q))
        rows = np.flatnonzero(saved)
        return rows, saved[rows]


def search_block(
    q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, pivots: np.ndarray, posted: int, probed: int, share: float, k: int
) -> pd.DataFrame:
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    files, out = PivotFiles(v, pivots, posted), []
    for i, x, permutation in zip(q_ids, q, nearest_pivots(q, pivots, probed), strict=True):
        rows, saved = files.met(permutation)
        other = ids[rows] != i
        rows, saved = rows[other], saved[other]
        keep = max(k, int(np.ceil(share * len(rows))))
        if keep < len(rows):  # ties go to the smaller id
            rows = rows[np.argpartition(-saved * len(ids) + rows, keep)[:keep]]
        score = np.einsum("ij,j->i", v[rows], x)
        best = np.lexsort((ids[rows], -score))[:k]
        out.append(pd.DataFrame({"query_id": i, "vec_id": ids[rows][best], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def permutation_search(
    queries: DataFrame,
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    n_pivots: int = 1024,
    posted: int = 24,
    probed: int = 32,
    share: float = 0.7,
    block_rows: int = 16384,
    query_rows: int = 8192,
) -> DataFrame:
    """The k nearest vectors by inner product found for each query: (query_id, rank from 1, vec_id, score).

    queries and vectors carry id_col and vec_col; other columns are ignored. Vectors that are null, empty, zero or hold
    null or non-finite components take no part, on either side; so do vectors of another dimension than the most frequent one. A
    query never finds a row of its own id. Equal scores go to the smaller id, repeated rows are found once, and queries
    without any candidate have no rows. Every row is indexed; n_pivots vectors are sampled as pivots (documented bound).
    A row is posted in the files of its `posted` nearest pivots, a query walks those of its `probed` nearest and reranks
    `share` of what it meets. Vectors move once for each query_rows queries, queries once for each block_rows vectors.
    """
    spark = vectors.sparkSession
    base, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    pivots = choose_pivots(base, n_pivots)
    if not len(pivots):
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    fit = F.size("v") == pivots.shape[1]
    n_blocks = max(1, -(-base.count() // block_rows))
    n_asked = max(1, -(-asked.count() // query_rows))
    shared = spark.sparkContext.broadcast(pivots)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block")
    asked_block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_asked)).alias("asked_block")
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    held = base.where(fit).select("vec_id", "v", block, every(n_asked, "asked_block"))
    posed = asked.where(fit).select("vec_id", "v", asked_block, every(n_blocks, "block"))

    def pair(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        left, right = left.drop_duplicates("vec_id"), right.drop_duplicates("vec_id")
        return search_block(
            left["vec_id"].to_numpy(), np.stack(left["v"]), right["vec_id"].to_numpy(), np.stack(right["v"]), shared.value, posted, probed, share, k
        )

    n_tasks = max(task_count(spark), min(4 * n_blocks * n_asked, 2000))
    found = (
        posed.repartition(n_tasks, "block", "asked_block")
        .groupBy("block", "asked_block")
        .cogroup(held.repartition(n_tasks, "block", "asked_block").groupBy("block", "asked_block"))
        .applyInPandas(pair, NEIGHBOURS)
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact's (query_id, vec_id) pairs that found holds too."""
    pairs = exact.select("query_id", "vec_id").distinct()
    hit = pairs.join(found.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_semi").count()
    return hit / max(1, pairs.count())
