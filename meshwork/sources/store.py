"""The graph store: nodes and edges as Parquet folders, with versions, and the session façade over them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.bits import from_binary, to_binary
from ..functions.fingerprints import sha_chain
from ..operators import causal, patterns, relations, search

#: What nodes have if nothing else is said (fixed values).
NODE_DEFAULTS = {"qidx": 128, "version": 1, "content": ""}


def connect(spark: SparkSession, path: str, create: bool = True, read_only: bool = False) -> Store:
    return Store(spark, path, create, read_only)


class Store:
    """A folder of table/v=N Parquet snapshots. Reads take the newest version unless one is checked out.

    Each append is a folder of its own, so append many rows at a time; add_node and add_edge are for a few. A version is
    claimed by making its folder, so that of two writers at once the later one takes the next number. Readers see a version
    once its writer has finished it.
    """

    def __init__(self, spark: SparkSession, path: str, create: bool = True, read_only: bool = False, version: int | None = None):
        self.spark, self.path, self.read_only, self.version = spark, path.rstrip("/"), read_only, version
        if create and not read_only and version is None:
            for name in ("nodes", "edges"):
                if not self._versions(name):
                    spark.createDataFrame([], schema.get_schema(name)).write.parquet(f"{self.path}/{name}/v=0")

    def _versions(self, name: str) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/{name}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        # what a crashed or running writer has left has no marker yet
        return sorted(int(x.getName()[2:]) for x in found if x.getName().startswith("v=") and fs.exists(hadoop.Path(x, "_SUCCESS")))

    def table(self, name: str) -> DataFrame:
        """All parts written up to the version that is read."""
        own = [v for v in self._versions(name) if self.version is None or v <= self.version]
        if not own:
            raise FileNotFoundError(f"no table {name!r} in {self.path}")
        return self.spark.read.schema(schema.get_schema(name)).parquet(*[f"{self.path}/{name}/v={v}" for v in own])

    @property
    def nodes(self) -> DataFrame:
        return self.table("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.table("edges")

    def append(self, name: str, df: DataFrame) -> int:
        """A new version that adds df's rows; missing columns are null, unknown ones go to properties as JSON."""
        if self.read_only or self.version is not None:
            raise PermissionError("this store is read-only")
        version = max(self._versions(name), default=-1) + 1
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        # a marker that only one writer can create
        while not self._claimed(fs, hadoop.Path(f"{self.path}/{name}/_claims/v={version}")):
            version += 1
        schema.conform(df, schema.get_schema(name)).write.parquet(f"{self.path}/{name}/v={version}")
        return version

    @staticmethod
    def _claimed(fs: JavaObject, marker: JavaObject) -> bool:
        """Whether this writer made the marker, which fails where it is there already."""
        try:
            return fs.createNewFile(marker)
        except Py4JJavaError:
            return False

    def add_nodes(self, df: DataFrame) -> int:
        defaults = {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in NODE_DEFAULTS.items()}
        style = F.array(*[F.lit(0.5)] * 7)
        defaults["thinking_style"] = F.coalesce("thinking_style", style) if "thinking_style" in df.columns else style
        return self.append("nodes", df.withColumns(defaults))

    def add_edges(self, df: DataFrame) -> int:
        for c in ("weight", "amplification"):
            df = df if c in df.columns else df.withColumn(c, F.lit(1.0))
        key = F.concat("from_id", F.lit("->"), "to_id", F.lit(":"), "type")
        return self.append("edges", df if "id" in df.columns else df.withColumn("id", key))

    def add_node(self, id: str, label: str, **props: object) -> int:
        return self.add_nodes(self.spark.createDataFrame([{"id": id, "label": label, **props}]))

    def add_edge(self, from_id: str, to_id: str, type: str, **props: object) -> int:
        return self.add_edges(self.spark.createDataFrame([{"from_id": from_id, "to_id": to_id, "type": type, **props}]))

    def link(self, kind: str, from_id: str, to_id: str, amplification: float | None = None) -> int:
        """causes, amplifies, enables, triggers or correlates, with their defaults."""
        rows = causal.causal_edge(kind, from_id, to_id, amplification)
        return self.add_edges(self.spark.createDataFrame(rows))

    def register(self) -> None:
        """Tables as temporary views, for sql()."""
        for name in ("nodes", "edges"):
            self.table(name).createOrReplaceTempView(name)

    def sql(self, text: str, **args: object) -> DataFrame:
        """Spark SQL over the views; $name and :name are bound parameters, never text."""
        self.register()
        marked = re.sub(r"\$([A-Za-z_]\w*)", r":\1", text) if args else text
        return self.spark.sql(marked, args=args or None)

    def match(self, pattern: Sequence[patterns.Node | patterns.Edge], **how: object) -> DataFrame:
        return patterns.match(self.nodes.drop("fingerprint", "embedding", "scent", "thinking_style"), self.edges, pattern, **how)

    def prints(self) -> DataFrame:
        return self.nodes.where(F.col("fingerprint").isNotNull()).withColumn("words", from_binary(F.col("fingerprint")))

    def find_similar(self, query: Column, k: int = 10, where: Column | None = None) -> DataFrame:
        return search.knn(self.prints(), query, k, where=where)

    def resonate(self, query: Column, threshold: float = 0.6, where: Column | None = None) -> DataFrame:
        return search.resonate(self.prints(), query, threshold, where=where)

    def resonate_content(self, text: str, threshold: float = 0.6, limit: int = 10) -> DataFrame:
        return self.resonate(sha_chain(F.lit(text)), threshold).limit(limit)

    def vector_search(self, vector: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
        return search.vector_search(self.nodes, vector, k, where=where)

    def butterflies(self, source: str, threshold: float = 2.0, most: int = 10) -> DataFrame:
        return causal.butterfly_paths(self._start(source), self.edges, threshold, most)

    def impact(self, source: str, most: int = 10) -> DataFrame:
        """(reach, butterflies, max_amplification) of source; amplification 1 without butterflies."""
        return causal.impact_totals(self._start(source), self.edges, most).drop("start")

    def _start(self, source: str) -> DataFrame:
        return self.spark.createDataFrame([(source,)], "id string")

    def checkout(self, version: int) -> Store:
        return Store(self.spark, self.path, create=False, read_only=True, version=version)

    def diff(self, old: int, new: int, name: str = "nodes") -> DataFrame:
        columns = [c for c in schema.get_schema(name).names]
        return relations.snapshot_diff(self.checkout(old).table(name).select(columns), self.checkout(new).table(name).select(columns))


def with_print(df: DataFrame, identity: Column) -> DataFrame:
    """df with a fingerprint column as it is stored."""
    return df.withColumn("fingerprint", to_binary(sha_chain(identity)))
