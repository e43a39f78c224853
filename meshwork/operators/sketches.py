"""Mergeable sketches of column chunks: distinct counts and quantiles of any range of chunks without reading rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Log2 of the registers of a distinct-count sketch: a relative standard error of about 1.6 % at 12; small counts are exact.
REGISTERS = 12
#: The size of a quantile sketch: a rank error of about 1.3 % at 200, with 99 % confidence.
QUANTILES = 200


def sketched(column: DataFrame, registers: int = REGISTERS, size: int = QUANTILES) -> DataFrame:
    """(chunk, n_values, null_count, min_value, max_value, distinct_sketch, quantile_sketch) of a column of numbers (chunk, value).

    Sketches are partial aggregates: they are built where rows are read and merged, so no values are shuffled, where an
    exact distinct count sends every value of every chunk. Nulls are in neither sketch.
    """
    value = F.col("value").cast("double")
    return column.groupBy("chunk").agg(
        F.count("*").alias("n_values"), F.count_if(F.col("value").isNull()).alias("null_count"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.hll_sketch_agg(F.col("value").cast("string"), F.lit(registers)).alias("distinct_sketch"), F.kll_sketch_agg_double(value, F.lit(size)).alias("quantile_sketch"),
    )


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """The sketches of each group of chunks, as sketched() would make them of their rows together."""
    return sketches.groupBy(*keys).agg(
        F.sum("n_values").alias("n_values"), F.sum("null_count").alias("null_count"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )


def estimates(sketches: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """sketches with distinct_count, and quantiles as an array in the order of the shares, in place of the sketches; null without values."""
    some = F.col("n_values") > F.col("null_count")
    quantiles = F.array(*[F.when(some, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(s))) for s in shares])
    count = F.coalesce(F.hll_sketch_estimate("distinct_sketch"), F.lit(0)).cast("long")
    return sketches.withColumns({"distinct_count": count, "quantiles": F.when(some, quantiles)}).drop("distinct_sketch", "quantile_sketch")
