"""An inverted-file index for dense vectors with product-quantised residuals, stored as Parquet partitioned by cell.

Cells are the Voronoi cells of trained centroids. Each vector is posted to its nearest cells, with the code of its residual
there: the residual is cut into pieces, and each is replaced by the number of its nearest trained piece. A search ranks
the cells by their centroids, opens only the folders of those it probes, ranks their postings by codes alone, and computes
exact distances for the best of them. Distances are products of matrices, held for a slice of the rows at a time, so that a
task's memory doesn't grow with the number of cells, rows or queries.

An index is a folder: centroids and codebooks (one small table), cells (rows of each) and postings/cell=N.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources.scratch import Scratch
from .search import QUERY_BLOCK

#: Pieces of a residual, and codes of a piece; a code is a byte.
PIECES, CODES = 16, 256
#: Rows that cells and codebooks are trained on at most, and for each cell.
MOST_SAMPLED, SAMPLED_A_CELL = 1_000_000, 64
#: Bytes that all centroids may take: every task holds them.
CENTROID_BYTES = 64 << 20
ROUNDS = 12
#: Distances that a task holds at a time, 8 bytes each.
AT_ONCE = 1 << 20
#: Queries that are held against a batch of rows at a time, and those rows.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 256, AT_ONCE // 256
#: The nearest cells of a query that hold so many times its candidates give a bound for the codes of all the others.
BOUND_BY = 4
POSTING = "cell int, id long, code binary, vector array<float>"


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, by one product of matrices."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1), 0)


def nearest(x: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """(rows, n): the n nearest centroids of each row, nearest first, ties to the lesser number."""
    step, n = max(1, AT_ONCE // len(centroids)), min(n, len(centroids))
    out = np.empty((len(x), n), dtype=np.int64)
    for lo in range(0, len(x), step):
        far = squares(x[lo : lo + step], centroids)
        if n > 8:
            out[lo : lo + step] = np.argsort(far, axis=1, kind="stable")[:, :n]
            continue
        for place in range(n):
            out[lo : lo + step, place] = best = far.argmin(1)
            far[np.arange(len(far)), best] = np.inf
    return out


def trained(sample: DataFrame, n: int, dimension: int, groups: int = 1, rounds: int = ROUNDS) -> np.ndarray:
    """(groups, n, dimension / groups) centroids by Lloyd's rounds on a bounded sample (vector, place), those of the least places first: one job a round trains all
    groups, that is pieces of the vectors.

    A task returns a sum and a count for each centroid, so the driver gets as many rows as there are centroids and tasks.
    """
    width = dimension // groups
    first = np.array([r["vector"] for r in sample.orderBy("place").limit(n).collect()], dtype=np.float64)
    now = first.reshape(len(first), groups, width).transpose(1, 0, 2).copy()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(now), np.zeros(now.shape[:2])
        for b in batches:
            x = matrix(b.column("vector"), dimension)
            for g in range(groups):
                part = x[:, g * width : (g + 1) * width]
                own = nearest(part, now[g])[:, 0]
                np.add.at(total[g], own, part)
                count[g] += np.bincount(own, minlength=now.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([count.tobytes()], pa.binary())], ["total", "count"])

    for _ in range(rounds):
        parts = sample.select("vector").mapInArrow(summed, "total binary, count binary").collect()
        total = sum(np.frombuffer(r["total"]).reshape(now.shape) for r in parts)
        count = sum(np.frombuffer(r["count"]).reshape(now.shape[:2]) for r in parts)
        # a centroid that no vector is nearest to stays where it is
        now = np.where(count[:, :, None] > 0, total / np.maximum(count, 1)[:, :, None], now)
    return now


def residuals(sample: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The vectors of a sample (vector, place) less their nearest centroids, as arrays of doubles."""
    dimension = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part.slice(lo, 4096) for part in batches for lo in range(0, part.num_rows, 4096)):
            x = matrix(b.column("vector"), dimension)
            left = x - centroids[nearest(x, centroids)[:, 0]]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dimension, pa.int32()), pa.array(left.ravel())), b.column("place")], ["vector", "place"])

    return sample.select("vector", "place").mapInArrow(run, "vector array<double>, place long")


class Best:
    """The k nearest ids of each of n queries, as far as they have been met: ties to the lesser id, an id once."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), np.inf), np.zeros((n, k), dtype=np.int64)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        own = np.unique(q)
        held = np.isfinite(self.score[own]).ravel()
        q = np.concatenate([q, np.repeat(own, self.k)[held]])
        ids, score = np.concatenate([ids, self.id[own].ravel()[held]]), np.concatenate([score, self.score[own].ravel()[held]])
        order = np.lexsort((score, ids, q))
        q, ids, score = q[order], ids[order], score[order]
        once = np.r_[True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])]
        q, ids, score = q[once], ids[once], score[once]
        order = np.lexsort((ids, score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        self.score[own] = np.inf
        self.score[q[kept], rank[kept]], self.id[q[kept], rank[kept]] = score[kept], ids[kept]

    def meet(self, at: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Holds rows (ids, x) against the queries of these numbers. Products of matrices say which may be among the k nearest, with
        room for their rounding; those get their exact distance, summed in the order of the components."""
        squared = (x * x).sum(1)
        # of so many rows at least k have different ids
        enough = self.k * int(np.unique(ids, return_counts=True)[1].max())
        for lo in range(0, len(at), QUERIES_AT_ONCE):
            own = at[lo : lo + QUERIES_AT_ONCE]
            y = queries[own]
            size = (y * y).sum(1)
            far = squared - 2 * (y @ x.T)
            room = 1e-12 * (size + squared.max())
            most = np.square(self.score[own, -1]) - size
            if len(x) > enough and not np.isfinite(most).all():
                most = np.minimum(most, np.partition(far, enough - 1, axis=1)[:, enough - 1])
            i, j = np.nonzero(far <= (most + room)[:, None])
            if len(i):
                total = np.zeros(len(i))
                for d in range(x.shape[1]):
                    total += np.square(x[j, d] - y[i, d])
                self.add(own[i], ids[j], np.sqrt(total))


def grouped(cells: np.ndarray, mask: np.ndarray) -> dict[int, np.ndarray]:
    """{cell: the numbers of the queries that probe it} of (queries, probed) cells, where the mask is true."""
    of, query = cells[mask], np.nonzero(mask)[0].astype(np.int32)
    order = np.argsort(of, kind="stable")
    own, start = np.unique(of[order], return_index=True)
    return dict(zip(own.tolist(), np.split(query[order], start[1:]), strict=True)) if len(own) else {}


@dataclass
class Coder:
    """Centroids (cells, dimension) and codebooks (pieces, codes, dimension / pieces)."""

    centroids: np.ndarray
    books: np.ndarray

    @property
    def pieces(self) -> int:
        return len(self.books)

    def cells_of(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each row, nearest first, ties to the lesser cell."""
        return nearest(x, self.centroids, n)

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        width = residuals.shape[1] // self.pieces
        return np.concatenate([nearest(residuals[:, g * width : (g + 1) * width], self.books[g]) for g in range(self.pieces)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The residuals that (rows, pieces) codes stand for."""
        return np.concatenate([self.books[g][codes[:, g]] for g in range(self.pieces)], axis=1)


def cells_for(n_rows: int, dimension: int) -> int:
    """Six times the root of the rows, at most a cell for eight rows and as many as CENTROID_BYTES hold."""
    return max(1, min(math.ceil(6 * math.sqrt(n_rows)), n_rows // 8, CENTROID_BYTES // (8 * dimension)))


class VectorIndex:
    """Opened by VectorIndex.build(...) or VectorIndex(spark, path)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        kept = {r["name"]: r for r in spark.read.parquet(f"{self.path}/trained").collect()}
        as_array = lambda r: np.frombuffer(r["data"]).reshape(r["shape"])
        self.coder = Coder(as_array(kept["centroids"]), as_array(kept["books"]))
        self.dimension = self.coder.centroids.shape[1]
        #: rows of each cell that has any; a row for each cell
        self.sizes = {r["cell"]: r["n"] for r in spark.read.parquet(f"{self.path}/cells").collect()}

    @classmethod
    def build(
        cls, corpus: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", n_cells: int | None = None, posted: int = 1, pieces: int = PIECES, seed: int = 5
    ) -> VectorIndex:
        """Trains on a sample of at most SAMPLED_A_CELL rows a cell and MOST_SAMPLED in all, and posts every vector to its `posted`
        nearest cells: more than one where vectors form no clusters, so that a border between cells hides less.

        Vectors that are null, of another dimension than most or not finite are left out. Rows are shuffled once, by cell, and
        a cell with a large share of them is split among tasks (rebalanced). An empty corpus is an error.
        """
        spark = corpus.sparkSession
        rows = corpus.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
        dims = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
        if not dims or not dims[0]["d"]:
            raise ValueError("there are no vectors to index")
        dimension, n_rows = dims[0]["d"], dims[0]["n"]
        finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = rows.where((F.size("vector") == dimension) & finite)
        n_cells = n_cells or cells_for(n_rows, dimension)
        pieces = next(p for p in range(min(pieces, dimension), 0, -1) if dimension % p == 0)
        with Scratch(spark) as scratch:
            share = min(1.0, max(SAMPLED_A_CELL * n_cells, SAMPLED_A_CELL * CODES) * 1.2 / n_rows, MOST_SAMPLED / n_rows)
            sample = scratch.written((rows if share == 1 else rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20))).select("vector", F.xxhash64("vector", F.lit(seed)).alias("place")), "sample")
            centroids = trained(sample, n_cells, dimension)[0]
            books = trained(scratch.written(residuals(sample, centroids), "residuals"), CODES, dimension, pieces)
        coder = Coder(centroids, books)
        saved = [(n, a.tobytes(), list(a.shape)) for n, a in (("centroids", centroids), ("books", books))]
        spark.createDataFrame(saved, "name string, data binary, shape array<int>").coalesce(1).write.parquet(f"{path}/trained")
        sent = spark.sparkContext.broadcast(coder)

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for b in (part.slice(lo, 2048) for part in batches for lo in range(0, part.num_rows, 2048)):
                x = matrix(b.column("vector"), dimension)
                cells = own.cells_of(x, posted)
                for place in range(cells.shape[1]):
                    codes = own.encode(x - own.centroids[cells[:, place]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells[:, place], pa.int32()), b.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), b.column("vector")], ["cell", "id", "code", "vector"]
                    )

        postings = rows.mapInArrow(post, POSTING).hint("rebalance", "cell")
        postings.write.partitionBy("cell").parquet(f"{path}/postings")
        cells = spark.read.schema(POSTING).parquet(f"{path}/postings").groupBy("cell").agg(F.count("*").alias("n"))
        cells.coalesce(1).write.parquet(f"{path}/cells")
        return cls(spark, path)

    def postings(self, cells: list[int] | None = None) -> DataFrame:
        """The postings of these cells; the folders of others aren't listed."""
        own = self.sizes if cells is None else [c for c in cells if c in self.sizes]
        if not own:
            return self.spark.createDataFrame([], POSTING)
        return self.spark.read.schema(POSTING).option("basePath", f"{self.path}/postings").parquet(*[f"{self.path}/postings/cell={c}" for c in own])

    def nearest_cells(self, queries: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each query that have rows."""
        filled = np.array(sorted(self.sizes))
        return filled[Coder(self.coder.centroids[filled], self.coder.books).cells_of(queries, n)]

    def search(self, queries: DataFrame, k: int, probed: int, over: int | None = 10, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
        """(query_id, rank, id, score): the k nearest vectors of each query by l2 distance, among those of its `probed` nearest
        cells, ties to the lesser id.

        Codes alone choose over * k candidates for a query; their exact distances decide. With over None every posting that
        is met is compared exactly, so with all cells probed the result is exact: that is queries times vectors, as products
        of matrices, and k rows a query leave a task. Queries that are null, of another dimension or not finite have no
        rows. They are a stated set, counted and sent to the tasks in blocks; only the cells that a block probes are opened.
        Of a cell, the codes are read first, and vectors of the candidates' cells only.
        """
        asked = queries.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == self.dimension)).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("q"))
        asked = asked.where(F.forall("q", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        parts = [self._block(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i), k, probed, over) for i in range(n_blocks)]
        return reduce(DataFrame.unionByName, parts)

    def _block(self, asked: DataFrame, k: int, probed: int, over: int | None) -> DataFrame:
        rows = asked.collect()  # about QUERY_BLOCK queries
        ids, x = np.array([r["query_id"] for r in rows], dtype=np.int64), np.array([r["q"] for r in rows], dtype=np.float64).reshape(len(rows), self.dimension)
        if over is None and rows and probed >= len(self.sizes):
            each = self._exact(self.postings(), ids, x, None, k)
        else:
            cells = self.nearest_cells(x, probed) if rows else np.zeros((0, 1), int)
            by_cell = grouped(cells, np.ones(cells.shape, bool))
            postings = self.postings(sorted(by_cell))
            if over is None:
                each = self._exact(postings, ids, x, by_cell, k)
            else:
                most = self._bounds(ids, x, cells, over * k)
                met = self._candidates(postings, ids, x, by_cell, over * k, most).join(postings.select("cell", "id", "vector"), ["cell", "id"]).join(F.broadcast(asked), "query_id")
                each = met.select("query_id", "id", vectors.l2(F.col("vector"), F.col("q")).alias("score"))
        each = each.groupBy("query_id", "id").agg(F.min("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
        return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    def _exact(self, postings: DataFrame, ids: np.ndarray, x: np.ndarray, by_cell: dict[int, np.ndarray] | None, k: int) -> DataFrame:
        """(query_id, id, score) of the k nearest postings of each query that each task meets; without by_cell every query meets
        every cell."""
        sent = self.spark.sparkContext.broadcast((ids, x, by_cell))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x, by_cell = sent.value
            best, everything = Best(len(ids), k), np.arange(len(ids))
            for b in (part.slice(lo, ROWS_AT_ONCE) for part in batches for lo in range(0, part.num_rows, ROWS_AT_ONCE)):
                own, rows = b.column("id").to_numpy(), matrix(b.column("vector"), x.shape[1])
                if by_cell is None:
                    best.meet(everything, x, own, rows)
                    continue
                cell_of = b.column("cell").to_numpy(zero_copy_only=False)
                for cell in np.unique(cell_of):
                    at = np.flatnonzero(cell_of == cell)
                    best.meet(by_cell[int(cell)], x, own[at], rows[at])
            i, j = np.nonzero(np.isfinite(best.score))
            for lo in range(0, len(i), 1 << 16):
                p, r = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.array(best.id[p, r]), pa.array(best.score[p, r])], ["query_id", "id", "score"])

        return postings.select("cell", "id", "vector").mapInArrow(run, "query_id long, id long, score double")

    def _bounds(self, ids: np.ndarray, x: np.ndarray, cells: np.ndarray, most: int) -> np.ndarray:
        """Of each query the distance by codes of its `most`-th nearest id among its very nearest cells, inf if they hold fewer:
        what is further isn't among the `most` nearest of all the cells it probes."""
        if not len(ids):
            return np.zeros(0)
        sizes = np.zeros(max(self.sizes) + 1, dtype=np.int64)
        sizes[list(self.sizes)] = list(self.sizes.values())
        held = sizes[cells]
        by_cell = grouped(cells, held.cumsum(1) - held < BOUND_BY * most)
        found = self._nearest_codes(self._candidate_codes(self.postings(sorted(by_cell)), ids, x, by_cell, most, np.full(len(ids), np.inf)))
        bounds = {r["query_id"]: r["far"] for r in found.where(F.col("_n") == most).select("query_id", "far").collect()}
        # products of matrices of another shape may round otherwise
        return np.array([bounds.get(i, np.inf) for i in ids.tolist()]) * (1 + 1e-9) + 1e-9

    def _candidate_codes(self, postings: DataFrame, ids: np.ndarray, x: np.ndarray, by_cell: dict[int, np.ndarray], most: int, bounds: np.ndarray) -> DataFrame:
        """(query_id, cell, id, far): of each query and cell the `most` nearest postings by their codes, within the query's bound."""
        sent = self.spark.sparkContext.broadcast((self.coder, ids, x, by_cell, bounds))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder, ids, x, by_cell, bounds = sent.value
            for b in (part.slice(lo, ROWS_AT_ONCE) for part in batches for lo in range(0, part.num_rows, ROWS_AT_ONCE)):
                cell_of, own = b.column("cell").to_numpy(zero_copy_only=False), b.column("id").to_numpy()
                codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                for cell in np.unique(cell_of):
                    at = np.flatnonzero(cell_of == cell)
                    # equal codes are equally far
                    kinds, which = np.unique(codes[at], axis=0, return_inverse=True)
                    decoded, asking = coder.decode(kinds) + coder.centroids[cell], by_cell[int(cell)]
                    for lo in range(0, len(asking), QUERIES_AT_ONCE):
                        part = asking[lo : lo + QUERIES_AT_ONCE]
                        far = squares(x[part], decoded)[:, which.ravel()]
                        most_far = bounds[part]
                        if len(at) > most:
                            most_far = np.minimum(most_far, np.partition(far, most - 1, axis=1)[:, most - 1])
                        i, j = np.nonzero(far <= most_far[:, None])
                        if len(i):
                            columns = [pa.array(ids[part[i]]), pa.array(np.full(len(i), cell, np.int32)), pa.array(own[at[j]]), pa.array(far[i, j])]
                            yield pa.RecordBatch.from_arrays(columns, ["query_id", "cell", "id", "far"])

        return postings.select("cell", "id", "code").mapInArrow(run, "query_id long, cell int, id long, far double")

    @staticmethod
    def _nearest_codes(far: DataFrame) -> DataFrame:
        # a vector that is posted to several cells is one candidate
        once = far.groupBy("query_id", "id").agg(F.min(F.struct("far", "cell")).alias("b")).select("query_id", "id", "b.far", "b.cell")
        return once.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("far", "id")))

    def _candidates(self, postings: DataFrame, ids: np.ndarray, x: np.ndarray, by_cell: dict[int, np.ndarray], most: int, bounds: np.ndarray) -> DataFrame:
        """(query_id, cell, id) of the `most` nearest postings of each query by their codes, one for an id."""
        ranked = self._nearest_codes(self._candidate_codes(postings, ids, x, by_cell, most, bounds))
        return ranked.where(F.col("_n") <= most).select("query_id", "cell", "id")
