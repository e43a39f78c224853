"""Column analytics: chunk statistics and pruning, and the lightweight encodings as relational operators with inverses.

Parquet encodes and prunes at rest; these operators show what each encoding would give, and transform columns where that is
wanted. A column is a DataFrame (chunk, pos, value): pos is the place in the column, chunk = pos div size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows of a chunk, distinct values that a dictionary may hold, and those up to which it is tried (fixed values).
CHUNK_ROWS, MOST_CODES, FEW_CODES, WIDEST = 10_000, 65_536, 256, 16


def as_column(df: DataFrame, order: list[str], value: str, size: int = CHUNK_ROWS) -> DataFrame:
    """(chunk, pos, value) of a column, numbered by `order` over the whole table.

    Numbering doesn't gather the table: rows are range-partitioned, counted by partition, and numbered within theirs.
    """
    n_parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = written(df.select(*order, F.col(value).alias("value")).repartitionByRange(n_parts, *order).withColumn("_part", F.spark_partition_id()), "laid")
    counts = laid.groupBy("_part").agg(F.count("*").alias("n"))
    base = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    numbered = laid.withColumn("_at", place).join(F.broadcast(base), "_part")  # a row for each partition
    pos = F.col("base") + F.col("_at")
    return numbered.select(F.floor(pos / size).alias("chunk"), pos.alias("pos"), "value")


def chunk_stats(column: DataFrame) -> DataFrame:
    return column.groupBy("chunk").agg(
        F.count("*").alias("n_values"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.count_if(F.col("value").isNull()).alias("null_count"), F.countDistinct("value").alias("distinct_count"),
    )


def prune_chunks(stats: DataFrame, least: object = None, most: object = None) -> DataFrame:
    """The chunks that may hold values between the bounds; chunks without statistics stay."""
    keep: Column = F.lit(True)
    if least is not None:
        keep = keep & (F.col("max_value").isNull() | (F.col("max_value") >= F.lit(least)))
    if most is not None:
        keep = keep & (F.col("min_value").isNull() | (F.col("min_value") <= F.lit(most)))
    return stats.where(keep)


def run_lengths(column: DataFrame) -> DataFrame:
    """RLE: (chunk, run, value, run_length); nulls are values of their own."""
    order = Window.partitionBy("chunk").orderBy("pos")
    new = ~F.col("value").eqNullSafe(F.lag("value").over(order)) | F.lag("pos").over(order).isNull()
    runs = column.withColumn("run", F.sum(new.cast("int")).over(order))
    return runs.groupBy("chunk", "run").agg(F.first("value").alias("value"), F.count("*").alias("run_length"))


def from_run_lengths(runs: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    start = F.coalesce(F.sum("run_length").over(Window.partitionBy("chunk").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = runs.withColumn("_s", start).select("chunk", "value", F.explode(F.sequence(F.col("_s"), F.col("_s") + F.col("run_length") - 1)).alias("i"))
    return each.select("chunk", (F.col("chunk") * size + F.col("i")).alias("pos"), "value")


def deltas(column: DataFrame) -> DataFrame:
    """(chunk, pos, delta): the first value of a chunk, then differences. Values are whole numbers without nulls."""
    return column.select("chunk", "pos", (F.col("value") - F.coalesce(F.lag("value").over(Window.partitionBy("chunk").orderBy("pos")), F.lit(0))).alias("delta"))


def from_deltas(encoded: DataFrame) -> DataFrame:
    total = F.sum("delta").over(Window.partitionBy("chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return encoded.select("chunk", "pos", total.alias("value"))


def bit_width(span: Column) -> Column:
    """Bits for the numbers from 0 to span: 1 for a single value."""
    return F.greatest(F.lit(1), F.ceil(F.log2(span.cast("double") + 1)).cast("int"))


def frame_of_reference(column: DataFrame) -> DataFrame:
    """(chunk, pos, reference, offset, width): each value less its chunk's least."""
    w = Window.partitionBy("chunk")
    least = F.min("value").over(w)
    return column.select("chunk", "pos", least.alias("reference"), (F.col("value") - least).alias("offset"), bit_width(F.max("value").over(w) - least).alias("width"))


def from_frame_of_reference(encoded: DataFrame) -> DataFrame:
    return encoded.select("chunk", "pos", (F.col("reference") + F.col("offset")).alias("value"))


def dictionary(column: DataFrame) -> DataFrame:
    """(chunk, value, code): codes by first appearance in the chunk. More than 65,536 values of a chunk are an error."""
    first = column.groupBy("chunk", "value").agg(F.min("pos").alias("first"))
    code = F.row_number().over(Window.partitionBy("chunk").orderBy("first")) - 1
    fail = F.raise_error(F.lit(f"a dictionary holds at most {MOST_CODES} values"))
    return first.withColumn("code", code).select("chunk", "value", F.when(F.col("code") < MOST_CODES, F.col("code")).otherwise(fail).alias("code"))


def dictionary_codes(column: DataFrame) -> DataFrame:
    own = dictionary(column).select(F.col("chunk").alias("c"), F.col("value").alias("v"), "code")
    return column.join(own, (F.col("chunk") == F.col("c")) & F.col("value").eqNullSafe(F.col("v"))).select("chunk", "pos", "code")


def from_dictionary(codes: DataFrame, table: DataFrame) -> DataFrame:
    return codes.join(table, ["chunk", "code"]).select("chunk", "pos", "value")


def encoding_choice(column: DataFrame) -> DataFrame:
    """(chunk, n_values, encoding, encoded_bytes, ratio): the encoding of the best ratio, first wins a tie.

    Sizes count real bytes. RLE is tried for over 10 values and counts if it halves them, frame of reference and delta
    (differences, then a frame) for whole numbers up to 16 bits, a dictionary for strings of up to 256 values.
    """
    kind = column.schema["value"].dataType.typeName()
    whole, text = kind in ("byte", "short", "integer", "long"), kind == "string"
    width = {"byte": 1, "short": 2, "integer": 4, "long": 8, "float": 4, "double": 8, "boolean": 1, "timestamp": 8, "timestamp_ntz": 8, "date": 4}.get(kind, 8)
    order = Window.partitionBy("chunk").orderBy("pos")
    size = F.coalesce(F.octet_length("value"), F.lit(0)) + 4 if text else F.lit(width)
    before = F.lag("value").over(order)
    new = ~F.col("value").eqNullSafe(before) | F.lag("pos").over(order).isNull()
    each = column.select("chunk", "value", size.alias("bytes"), new.alias("new"), *([(F.col("value") - before).alias("step")] if whole else []))
    out = each.groupBy("chunk").agg(
        F.count("*").alias("n_values"), F.sum("bytes").alias("plain"), F.sum(F.when(F.col("new"), F.col("bytes") + 4).otherwise(0)).alias("rle"),
        F.countDistinct("value").alias("d"),
        *([(F.max("value") - F.min("value")).alias("span"), (F.max("step") - F.min("step")).alias("step_span")] if whole else []),
    )
    packed = lambda w, extra: F.ceil(F.col("n_values") * w / 8) + extra
    tries = {"plain": F.col("plain"), "rle": F.when((F.col("n_values") > 10) & (2 * F.col("rle") <= F.col("plain")), F.col("rle"))}
    if whole:
        tries["for"] = F.when(bit_width(F.col("span")) <= WIDEST, packed(bit_width(F.col("span")), 8 + 1))
        tries["delta"] = F.when(bit_width(F.coalesce("step_span", F.lit(0))) <= WIDEST, packed(bit_width(F.coalesce("step_span", F.lit(0))), 16 + 1))
    if text:
        values = column.select("chunk", "value").distinct()
        held = values.groupBy("chunk").agg(F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + 4).alias("held"))
        out = out.join(held, "chunk")
        tries["dictionary"] = F.when(F.col("d") <= FEW_CODES, packed(bit_width(F.greatest(F.col("d") - 1, F.lit(0))), 0) + F.col("held"))
    ranked = F.array(*[F.struct(F.coalesce(b, F.lit(1 << 60)).cast("long").alias("bytes"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, b) in enumerate(tries.items())])
    best = out.withColumn("b", F.array_min(ranked))
    return best.select("chunk", "n_values", F.col("b.name").alias("encoding"), F.col("b.bytes").alias("encoded_bytes"), (F.col("plain") / F.col("b.bytes")).alias("ratio"))
