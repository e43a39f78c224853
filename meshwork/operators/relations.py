"""Joins and reductions that SQL engines name and Spark composes: latest per key, as-of, range, top-k, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """DISTINCT ON: the first row of each key by the order given."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", n).where(F.col("rank") <= k)


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, values: list[str]) -> DataFrame:
    """left with the values of the latest right row of the same keys at or before it; null without any.

    Both sides are laid in one order and the last right values carried forward: one shuffle by the keys, no range join.
    Right rows of one key and time: the greatest values stand.
    """
    value = F.struct(*values)
    a = left.withColumns({"_t": F.col(left_on), "_side": F.lit(1), "_v": F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)})
    b = right.select(*keys, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), value.alias("_v"))
    order = Window.partitionBy(*keys).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(order))
    return both.where("_side = 1").select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


#: Pairs that rows of one bucket and salt make at most, about.
PAIRS_A_SALT = 1_000_000


def range_join(left: DataFrame, right: DataFrame, point: str, lo: str, hi: str, width: float) -> DataFrame:
    """Rows of left whose point lies in right's [lo, hi): joined by buckets of the given width, then tested.

    The rows of both sides are counted in each bucket; where they make many pairs, left's rows are dealt by a salt and right's
    copied to each salt, so no task gets more than its share, however few buckets the points lie in. Both are dealt to as many
    tasks as shuffles have: by their bytes, which the pairs are not in proportion to, they would be joined in one.
    Equal rows of left have one salt.
    """
    bucket = lambda c: F.floor(c.cast("double") / width)
    a = left.withColumn("_bucket", bucket(F.col(point)))
    b = right.where(F.col(lo) < F.col(hi)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(lo)), bucket(F.col(hi)))))
    n = a.groupBy("_bucket").agg(F.count("*").alias("_a")).join(b.groupBy("_bucket").agg(F.count("*").alias("_b")), "_bucket")
    salts = n.select("_bucket", F.least(F.col("_a"), F.ceil(F.col("_a") * F.col("_b") / PAIRS_A_SALT)).cast("int").alias("_salts"))
    mark = F.xxhash64(*[F.col(c) for c in left.columns if not left.schema[c].dataType.typeName().startswith("map")], F.lit(5))
    dealt = a.join(salts, "_bucket").withColumn("_salt", F.pmod(mark, F.col("_salts")).cast("int")).drop("_salts")
    copied = b.join(salts, "_bucket").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda df: df.repartition(tasks, "_bucket", "_salt")
    return spread(dealt).join(spread(copied), ["_bucket", "_salt"]).where((F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))).drop("_bucket", "_salt")


def delete_by_id(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(ids.select(id_col).distinct(), id_col, "left_anti").select(*df.columns)


def update_by_id(df: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of ids there are replaced by the new ones; new ids are not added."""
    there = new.join(df.select(id_col).distinct(), id_col, "left_semi").select(*df.columns)
    return delete_by_id(df, new, id_col).unionByName(there)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of one side only, counted as often as they are more there, with change added or removed."""
    names = old.columns
    return new.select(*names).exceptAll(old).withColumn("change", F.lit("added")).unionByName(old.exceptAll(new.select(*names)).withColumn("change", F.lit("removed")))
