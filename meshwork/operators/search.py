"""Similarity search over fingerprints and dense vectors. A stated set of queries meets all rows; the queries are the small side."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, vectors
from ..schema import BITS
from ..sources.scratch import Scratch


#: Prints of queries that are broadcast at a time, 1,256 bytes each.
QUERY_BLOCK = 4096


def constant(corpus: DataFrame, query: Column) -> Column:
    """A query print as a literal: it is made once, not for each row."""
    words = corpus.sparkSession.sql("SELECT 1").select(query.alias("words")).first()["words"]
    return F.lit(None).cast("array<bigint>") if words is None else F.array(*map(F.lit, words)).cast("array<bigint>")


def distances(corpus: DataFrame, query: Column, words: str, where: Column | None) -> DataFrame:
    """corpus with its distances to one print, which a generator keeps the optimizer from computing at each use; rows without
    a print are left out."""
    rows = corpus if where is None else corpus.where(where)
    own = F.when(F.col(words).isNotNull(), bits.hamming(F.col(words), constant(corpus, query)))
    return rows.select(*[c for c in rows.columns if c != words], F.explode(F.array(own)).alias("distance")).where(F.col("distance").isNotNull())


def knn(corpus: DataFrame, query: Column, k: int, words: str = "words", id_col: str = "id", where: Column | None = None) -> DataFrame:
    """The k nearest prints to one print: (id, distance, similarity), null prints left out, ties to the lesser id."""
    found = distances(corpus, query, words, where).orderBy("distance", id_col).limit(k)
    return found.withColumn("similarity", 1 - F.col("distance") / BITS)


def resonate(corpus: DataFrame, query: Column, threshold: float = 0.6, words: str = "words", id_col: str = "id", where: Column | None = None) -> DataFrame:
    """All prints of at least this similarity, most similar first; the bound is tested on whole distances."""
    found = distances(corpus, query, words, where).where(F.col("distance") <= bits.most_distance(threshold))
    return found.withColumn("resonance", 1 - F.col("distance") / BITS).orderBy("distance", id_col)


def top(found: DataFrame, k: int = 1, by: str = "distance", id_col: str = "id") -> DataFrame:
    return found.orderBy(by, id_col).limit(k)


def above_threshold(found: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Results of at least this similarity, of knn's or hamming_join's rows."""
    return found.where(F.col("distance") <= bits.most_distance(threshold))


def hamming_join(queries: DataFrame, corpus: DataFrame, k: int, words: str = "words", most: int | None = None, recall: float = 1.0) -> DataFrame:
    """The k nearest prints of each query, at most `most` bits apart: (query_id, id, distance, similarity, rank).

    queries and corpus have (id, words). With a tight bound, at most TIGHT bits, and a recall below 1, pairs are found by
    near_pairs(), so the work doesn't grow with queries times corpus. Otherwise this is brute force: every query meets every
    print. The queries then are a stated set; they are counted and broadcast in blocks of about QUERY_BLOCK prints, one
    pass over the corpus for each, so that no broadcast grows with them.
    """
    if most is not None and most <= TIGHT and recall < 1:
        return ranked(near_pairs(queries, corpus, most, recall, k, words), k)
    left = queries.where(F.col(words).isNotNull()).select(F.col("id").alias("query_id"), bits.to_binary(F.col(words)).alias("q"))
    right = corpus.where(F.col(words).isNotNull()).select("id", bits.to_binary(F.col(words)).alias("w"))
    n_blocks = max(1, -(-left.count() // QUERY_BLOCK))

    def met(block: DataFrame) -> DataFrame:
        pairs = right.join(F.broadcast(block)).select("query_id", "id", bits.hamming_packed("q", "w").alias("distance"))
        return ranked(pairs if most is None else pairs.where(F.col("distance") <= most), k)

    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    # a query lies in one block, so its rank there is its rank
    return reduce(DataFrame.unionByName, [met(left.where(block == i)) for i in range(n_blocks)]).withColumn("similarity", 1 - F.col("distance") / BITS)


#: Distances up to which sampled bits tell near prints from others.
TIGHT = 2000
#: Bits of a sample: at least so many, so that of unrelated prints few meet, and at most so many.
LEAST_SAMPLED, MOST_SAMPLED = 14, 40


def sampling(n: int, most: int, recall: float) -> tuple[int, int]:
    """(bits of a sample, number of tables): prints at `most` bits meet in some table with probability `recall`.

    Samples have about log2(n) bits, so that a print meets about one unrelated print of n in each table.
    """
    size = min(MOST_SAMPLED, max(LEAST_SAMPLED, math.ceil(math.log2(max(2, n)))))
    alike = (1 - most / BITS) ** size
    return size, max(1, math.ceil(math.log1p(-recall) / math.log1p(-alike))) if alike < 1 else 1


def sampled_keys(prints: DataFrame, size: int, tables: int, seed: int = 17) -> DataFrame:
    """(print, table_no, key): of each print (binary) the bits that each table samples."""
    places = np.random.default_rng(seed).integers(0, BITS, (tables, size))
    at = np.arange(tables, dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                held = np.unpackbits(np.frombuffer(b"".join(part.column("w").to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1, bitorder="little")
                key = (held[:, places].astype(np.int64) << np.arange(size)).sum(2)
                ids = pa.array(np.repeat(np.arange(part.num_rows), tables))
                yield pa.RecordBatch.from_arrays([part.column("print").take(ids), pa.array(np.tile(at, part.num_rows)), pa.array(key.ravel())], ["print", "table_no", "key"])

    return prints.select("print", "w").mapInArrow(run, "print binary, table_no int, key long")


def near_pairs(queries: DataFrame, corpus: DataFrame, most: int, recall: float = 0.99, k: int | None = None, words: str = "words") -> DataFrame:
    """(query_id, id, distance, similarity) of prints at most `most` bits apart, each with probability `recall` or more, if most
    is at most TIGHT; what is returned is verified and exact.

    Tables sample bits; prints that agree in all bits of a sample are candidates. Equal prints are one print, told by a
    digest, so copies neither meet one another nor repeat comparisons. With k, each print stands for the k least of its ids,
    which is all that the k nearest of a query can need. Null prints are left out.
    """
    if not 0 <= most <= TIGHT or not 0 < recall < 1:
        raise ValueError(f"sampled bits find prints at most {TIGHT} bits apart, with a recall below 1")

    def of(df: DataFrame, id_name: str) -> DataFrame:
        held = df.where(F.col(words).isNotNull()).select(F.col("id").alias(id_name), bits.to_binary(F.col(words)).alias("w"))
        return held.select(id_name, F.unhex(F.md5("w")).alias("print"), "w")

    scratch = Scratch(queries.sparkSession)
    asked, known = scratch.written(of(queries, "query_id"), "queries", keep=True), scratch.written(of(corpus, "id"), "corpus", keep=True)
    each = lambda df: df.groupBy("print").agg(F.first("w").alias("w"))
    left, right = scratch.written(each(asked), "left", keep=True), scratch.written(each(known), "right", keep=True)
    size, tables = sampling(right.count(), most, recall)
    a, b = (sampled_keys(df, size, tables).withColumnRenamed("print", name) for df, name in ((left, "a"), (right, "b")))
    met = a.join(b, ["table_no", "key"]).select("a", "b").distinct()
    held = lambda df, p, w: df.select(F.col("print").alias(p), F.col("w").alias(w))
    pairs = met.join(held(left, "a", "wa"), "a").join(held(right, "b", "wb"), "b").select("a", "b", bits.hamming_packed("wa", "wb").alias("distance"))
    near = pairs.where(F.col("distance") <= most)
    members = known.select("id", F.col("print").alias("b"))
    if k is not None:
        members = members.withColumn("_n", F.row_number().over(Window.partitionBy("b").orderBy("id"))).where(F.col("_n") <= k).drop("_n")
    found = near.join(asked.select("query_id", F.col("print").alias("a")), "a").join(members, "b")
    return found.select("query_id", "id", "distance", (1 - F.col("distance") / BITS).alias("similarity"))


def ranked(pairs: DataFrame, k: int, query_id: str = "query_id", by: str = "distance", id_col: str = "id") -> DataFrame:
    """The k first of each query; Spark keeps k rows a task before it shuffles (window group limit)."""
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(by, id_col))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_search(
    corpus: DataFrame, query: list[float], k: int, column: str = "embedding", id_col: str = "id", metric: str = "l2", where: Column | None = None
) -> DataFrame:
    """Exact k nearest vectors by l2, or by cosine or inner product, greatest first: (the corpus's columns, score)."""
    q = vectors.literal(query)
    score = {"l2": vectors.l2, "cosine": vectors.cosine, "dot": vectors.dot}[metric](F.col(column), q)
    rows = corpus.where(F.col(column).isNotNull() & (F.size(column) == len(query)))
    rows = (rows if where is None else rows.where(where)).withColumn("score", score)
    return rows.orderBy(F.col("score").asc() if metric == "l2" else F.col("score").desc_nulls_last(), id_col).limit(k)


def hybrid_search(corpus: DataFrame, vector: list[float], query: Column, k: int, column: str = "embedding", words: str = "words", id_col: str = "id", over: int = 10) -> DataFrame:
    """over * k candidates by vector distance, reranked by fingerprint distance."""
    near = vector_search(corpus, vector, over * k, column, id_col)
    return near.withColumn("distance", bits.hamming(F.col(words), query)).orderBy("distance", id_col).limit(k)


def within(queries: DataFrame, corpus: DataFrame, most: int, words: str = "words") -> DataFrame:
    """(query_id, id, distance) of all prints at most `most` bits from each query, by brute force in blocks of queries; nothing is ranked."""
    left = queries.where(F.col(words).isNotNull()).select(F.col("id").alias("query_id"), bits.to_binary(F.col(words)).alias("q"))
    right = corpus.where(F.col(words).isNotNull()).select("id", bits.to_binary(F.col(words)).alias("w"))
    n_blocks, block = max(1, -(-left.count() // QUERY_BLOCK)), F.xxhash64("query_id")
    parts = [right.join(F.broadcast(left.where(F.pmod(block, F.lit(n_blocks)) == i))) for i in range(n_blocks)]
    return reduce(DataFrame.unionByName, parts).select("query_id", "id", bits.hamming_packed("q", "w").alias("distance")).where(F.col("distance") <= most)


def nearest_anchor(noisy: DataFrame, anchors: DataFrame, words: str = "words") -> DataFrame:
    """Cleanup: each print's nearest anchor of the codebook, as (query_id, id, distance, similarity)."""
    return hamming_join(noisy, anchors, 1, words).drop("rank")


def cleaned_by_resonance(noisy: DataFrame, anchors: DataFrame, threshold: float = 0.6, words: str = "words") -> DataFrame:
    """Each print bundled with the anchors that resonate with it; unchanged if none does."""
    near = within(noisy, anchors, bits.most_distance(threshold), words).select(F.col("query_id").alias("id"), F.col("id").alias("anchor"))
    parts = near.join(anchors.select(F.col("id").alias("anchor"), words), "anchor").select("id", words)
    own = noisy.select("id", words)
    return bits.bundled(own.unionByName(parts), words, "id")


def novelty(found: DataFrame, queries: DataFrame) -> DataFrame:
    """1 - the mean similarity of each query's neighbours, 1 without any. found: hamming_join's rows."""
    mean = found.groupBy("query_id").agg((1 - F.avg("similarity")).alias("novelty"))
    return queries.select(F.col("id").alias("query_id")).join(mean, "query_id", "left").fillna(1.0, ["novelty"])


def cohesion(groups: DataFrame, group: str, words: str = "words") -> DataFrame:
    """The mean pairwise similarity of each group, from the ones of each bit: no pairs are made.

    Of n prints with c ones in a bit, c * (n - c) pairs differ in it. Groups of one print have cohesion 1.
    """
    counts = bits.counted(groups, words, group)
    differ = F.aggregate(bits.bit_counts(F.col("counts")), F.lit(0).cast("decimal(38,0)"), lambda a, c: (a + c.cast("decimal(19,0)") * (F.col("n") - c).cast("decimal(18,0)")).cast("decimal(38,0)"))
    apart = counts.select(group, "n", differ.alias("d")).groupBy(group).agg(F.sum("d").cast("double").alias("d"), F.max("n").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1.0) / 2
    return apart.select(group, F.when(F.col("n") > 1, 1 - F.col("d") / (pairs * BITS)).otherwise(1.0).alias("cohesion"))
