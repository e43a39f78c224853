"""File formats and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv", "text", "binaryFile", "avro", "jdbc")


def read(spark: SparkSession, kind: str, path: str | None = None, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A source of one of FORMATS; schemas are given, not inferred, where the format has none of its own."""
    if kind not in FORMATS:
        raise ValueError(f"format {kind!r} is none of {', '.join(FORMATS)}")
    reader = spark.read.format(kind).options(**options)
    reader = reader if schema is None else reader.schema(schema)
    return reader.load(path) if path else reader.load()


def write(df: DataFrame, kind: str, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None, **options: str) -> None:
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def to_arrow(df: DataFrame) -> object:
    return df.toArrow()


def migrate(df: DataFrame, renames: dict[str, str], schema: T.StructType) -> DataFrame:
    """Rows of another store as rows of this one: columns renamed, then conformed."""
    from ..schema import conform

    return conform(df.withColumnsRenamed(renames), schema)
