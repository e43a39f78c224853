"""Documents by fingerprint: a fluent collection over a DataFrame (id, content, tags, words)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import most_distance
from ..functions.fingerprints import xorshift
from ..sources.scratch import written
from . import relations, search


def encoded(df: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """(id, content, tags, words): the print of the content, or of the id where that is empty."""
    key = F.col(id_col).cast("string")
    tags = F.col("tags") if "tags" in df.columns else F.create_map().cast("map<string,string>")
    return df.select(key.alias("id"), F.col(content_col).alias("content"), tags.alias("tags"), xorshift(F.coalesce(F.nullif(content_col, F.lit("")), key)).alias("words"))


def content_print(text: str) -> Column:
    return xorshift(F.lit(text))


@dataclass(frozen=True)
class Documents:
    rows: DataFrame

    @classmethod
    def of(cls, df: DataFrame, id_col: str = "id", content_col: str = "content") -> Documents:
        return cls(encoded(df, id_col, content_col))

    def __len__(self) -> int:
        return self.rows.count()

    def __iter__(self):
        return self.rows.toLocalIterator()

    def filter(self, condition: Column) -> Documents:
        return Documents(self.rows.where(condition))

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Documents:
        return Documents(self.rows.transform(change))

    def extend(self, other: Documents) -> Documents:
        return Documents(self.rows.unionByName(other.rows))

    def delete(self, ids: DataFrame) -> Documents:
        return Documents(relations.delete_by_id(self.rows, ids))

    def update(self, other: Documents) -> Documents:
        return Documents(relations.update_by_id(self.rows, other.rows))

    def search(self, query: str | Column, top_k: int = 10, threshold: float | None = None) -> DataFrame:
        """The nearest documents; the threshold drops rows of the top k."""
        own = content_print(query) if isinstance(query, str) else query
        found = search.knn(self.rows, own, top_k)
        return found if threshold is None else found.where(F.col("distance") <= most_distance(threshold))

    def match(self, queries: Documents, top_k: int = 10) -> DataFrame:
        """(query_id, id, distance, similarity, rank) of every query in one job."""
        return search.hamming_join(queries.rows.select("id", "words"), self.rows.select("id", "words"), top_k)

    def shuffled(self, seed: int) -> Documents:
        return Documents(self.rows.orderBy(F.xxhash64("id", F.lit(seed)), "id"))

    def split(self, ratio: float) -> tuple[Documents, Documents]:
        """The first int(n * ratio) by id, and the rest; rows of one id stay together. The bound's id is found from the
        numbers of ids in ranges, so that no row is numbered over the whole table; null ids come first."""
        parts = self.rows.select(F.col("id")).repartitionByRange("id").withColumn("part", F.spark_partition_id())
        parts = written(parts, "ids")
        sizes = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}
        left = int(sum(sizes.values()) * ratio)
        if left == 0:
            return Documents(self.rows.limit(0)), self
        for part in sorted(sizes):
            if left <= sizes[part]:
                break
            left -= sizes[part]
        last = parts.where(F.col("part") == part).orderBy("id").offset(left - 1).limit(1).first()["id"]
        first = F.col("id").isNull() if last is None else F.col("id").isNull() | (F.col("id") <= F.lit(last))
        return Documents(self.rows.where(first)), Documents(self.rows.where(~first))

    def slice(self, start: int, stop: int) -> Documents:
        """The documents from place start to before stop, by id."""
        return Documents(self.rows.orderBy("id").offset(start).limit(max(0, stop - start)))

    def query(self) -> Query:
        return Query(self.rows)


@dataclass(frozen=True)
class Query:
    """content/like -> where -> at_least -> sort -> limit. Conditions are applied before the nearest are taken."""

    rows: DataFrame
    near: Column | None = None
    least: float | None = None
    order: tuple[Column, ...] = ()
    most: int | None = None

    def like(self, query: str | Column) -> Query:
        return replace(self, near=content_print(query) if isinstance(query, str) else query)

    def where(self, condition: Column) -> Query:
        return replace(self, rows=self.rows.where(condition))

    def at_least(self, threshold: float) -> Query:
        return replace(self, least=threshold)

    def sort(self, *order: Column) -> Query:
        return replace(self, order=order)

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    def run(self) -> DataFrame:
        out = self.rows
        if self.near is not None:
            out = search.resonate(out, self.near, 0.0 if self.least is None else self.least)
        out = out.orderBy(*self.order) if self.order else out
        return out if self.most is None else out.limit(self.most)


def by_score(df: DataFrame, key: str) -> DataFrame:
    """Sorted by a key of the scores map, greatest first; a missing one is 0."""
    return df.orderBy(F.coalesce(F.try_element_at("scores", F.lit(key)), F.lit(0.0)).desc(), "id")
