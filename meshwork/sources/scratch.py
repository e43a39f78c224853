"""Scratch tables in the folder that the driver and all executors share; they cut the lineage of iterative operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a folder of this machine, which only a local master may use."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir='/tmp')}"
        sc.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and a lost executor costs no recomputation."""
    return Scratch(df.sparkSession).written(df, name)


def clean(spark: SparkSession) -> None:
    """Removes every scratch table of this folder, once the results that read them are stored."""
    remove(spark, f"{shared_dir(spark)}/meshwork")


#: Spark's setting by which the shuffles of a query go at its end.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """The scratch tables of one operator. As a context it removes, at its end, all but those that the result still reads.

    Results are lazy, so what they read has to outlive the operator: written(..., keep=True). clean() removes that too.
    With tidy, what was shuffled for a table goes from the disks once the table is written, and tables are compressed more.
    """

    def __init__(self, spark: SparkSession, tidy: bool = False):
        self.spark, self.root, self.number = spark, f"{shared_dir(spark)}/meshwork/{uuid.uuid4().hex}", 0
        self.tidy = tidy
        self.folders: list[str] = []
        self.tables: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()

    def clear(self) -> None:
        """Removes all tables but those to keep."""
        for path in self.folders:
            remove(self.spark, path)
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.folders, self.tables = [], []

    @contextlib.contextmanager
    def _writer(self, df: DataFrame) -> Iterator[DataFrameWriter]:
        if not self.tidy:
            yield df.write
            return
        before = self.spark.conf.get(SHUFFLES_GO, None)
        self.spark.conf.set(SHUFFLES_GO, "true")
        try:
            yield df.write.option("compression", "zstd")
        finally:
            self.spark.conf.unset(SHUFFLES_GO) if before is None else self.spark.conf.set(SHUFFLES_GO, before)

    def written(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        self.number += 1
        path = f"{self.root}/{self.number}_{name}"
        with self._writer(df) as writer:
            writer.parquet(path)
        if not keep:
            self.folders.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, by: str, n: int) -> DataFrame:
        """df as a table in n buckets by a column, sorted by it: joins and groups by that column don't move its rows."""
        table = f"meshwork_{name}_{uuid.uuid4().hex}"
        self.tables.append(table)
        with self._writer(df) as writer:
            writer.bucketBy(n, by).sortBy(by).saveAsTable(table)
        return self.spark.table(table)
