"""Tables clustered along a space-filling curve, with a zone map of their files, and reads that open only files that may match.

Rows near one another in several columns lie in the same files: each column's values are replaced by the number of their
quantile range, whose bits are interleaved to a place on the Z-curve, and files are ranges of places. The zone map has
the least and greatest value of each column in each file; a read asks it first.

A clustered table is a folder: data (the files) and zones (a row a file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a column's place on the curve: 2**BITS quantile ranges.
BITS = 6


def as_number(df: DataFrame, column: str) -> Column:
    """A column of numbers, times or booleans as a double, for the curve only; nulls stay null."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind in ("string", "binary", "array", "map", "struct", "variant"):
        raise TypeError(f"{column} is of type {kind}: the curve orders numbers and times")
    return F.col(column).cast("double")


def curve_place(df: DataFrame, columns: list[str], bits: int = BITS) -> Column:
    """The place on the Z-curve of each row: ranges by approximate quantiles, so that skewed columns are cut evenly, too. Nulls
    lie in the first range."""
    cuts = [i / 2**bits for i in range(1, 2**bits)]
    found = df.agg(*[F.percentile_approx(as_number(df, c), cuts, 10_000).alias(str(i)) for i, c in enumerate(columns)]).first()
    place = F.lit(0).cast("long")
    for i, column in enumerate(columns):
        bounds = F.array(*map(F.lit, sorted(set(found[i] or [])))).cast("array<double>")
        own = F.coalesce(F.size(F.filter(bounds, lambda b, x=as_number(df, column): b <= x)), F.lit(0)).cast("long")
        for b in range(bits):
            one = F.shiftrightunsigned(own, b).bitwiseAND(F.lit(1).cast("long"))
            place = place.bitwiseOR(F.shiftleft(one, b * len(columns) + i))
    return place


def write_clustered(df: DataFrame, path: str, columns: list[str], files: int) -> None:
    """df as about `files` files along the curve through columns, with their zone map.

    One shuffle, by ranges of the curve's places. Places that hold many rows are split by the columns' own values, so equal
    rows alone may make a file large.
    """
    placed = df.withColumn("_place", curve_place(df, columns))
    laid = placed.repartitionByRange(files, "_place", *columns).sortWithinPartitions("_place", *columns).drop("_place")
    laid.write.parquet(f"{path}/data")
    zone_map(df.sparkSession.read.parquet(f"{path}/data"), columns).coalesce(1).write.parquet(f"{path}/zones")


def zone_map(data: DataFrame, columns: list[str]) -> DataFrame:
    """(file, rows, and for each column min_, max_ and nulls_) of every file that data reads; other columns aren't read."""
    stats = [x for c in columns for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{c}"))]
    return data.select(F.col("_metadata.file_name").alias("file"), *columns).groupBy("file").agg(F.count("*").alias("rows"), *stats)


def may_match(bounds: dict[str, tuple[object, object]]) -> Column:
    """Whether a file may hold rows with every column between its bounds, ends included; None is no bound. A file in which a
    bounded column is null throughout has no such rows."""
    keep = F.lit(True)
    for column, (least, most) in bounds.items():
        if least is not None:
            keep = keep & (F.col(f"max_{column}") >= F.lit(least))
        if most is not None:
            keep = keep & (F.col(f"min_{column}") <= F.lit(most))
    return keep


def read_clustered(spark: SparkSession, path: str, bounds: dict[str, tuple[object, object]] | None = None) -> DataFrame:
    """The rows between the bounds. Files that the zone map rules out are neither listed nor opened, and in the others the bounds
    are pushed down to row groups."""
    data = spark.read.schema(spark.read.parquet(f"{path}/data").schema).parquet
    if not bounds:
        return data(f"{path}/data")
    files = [r["file"] for r in spark.read.parquet(f"{path}/zones").where(F.coalesce(may_match(bounds), F.lit(False))).select("file").collect()]  # a name a file
    rows = data(*[f"{path}/data/{f}" for f in files]) if files else data(f"{path}/data").limit(0)
    for column, (least, most) in bounds.items():
        rows = rows if least is None else rows.where(F.col(column) >= F.lit(least))
        rows = rows if most is None else rows.where(F.col(column) <= F.lit(most))
    return rows
