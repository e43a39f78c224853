"""Joins with a side in which a few keys have a large share of the rows: those rows are dealt by a salt, the others plainly.

Adaptive execution splits large partitions of a shuffle once it has been written; this deals rows evenly from the start,
whatever follows the join in its stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that a hub's rows are dealt to.
SALTS = 32


def hub_keys(rows: DataFrame, key: str, share: float) -> list:
    """The keys with at least this share of the rows: at most 1 / share of them, so they may be known to the driver."""
    if not 0 < share <= 1:
        raise ValueError("a share is above 0 and at most 1")
    n = rows.agg(F.count(key)).first()[0]
    if not n:
        return []
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= share * n)
    return [r[0] for r in counted.orderBy(F.desc("_n"), key).collect()]


def hub_join(few: DataFrame, many: DataFrame, few_key: str, many_key: str, share: float, salts: int = SALTS, keys: list | None = None) -> DataFrame:
    """few joined to many where the keys are equal, all columns of both.

    Rows of many whose key is a hub's get a salt by their content, and the rows of few with such a key are copied to every
    salt: a copy for each of at most 1 / share keys' rows, not of the whole side. keys are many's hubs, if they are known.
    """
    keys = hub_keys(many, many_key, share) if keys is None else keys
    if not keys:
        return few.join(many, F.col(few_key) == F.col(many_key))
    is_hub = lambda c: F.coalesce(F.col(c).isin(*keys), F.lit(False))
    plain = few.where(~is_hub(few_key)).join(many.where(~is_hub(many_key)), F.col(few_key) == F.col(many_key))
    salt: Column = F.pmod(F.xxhash64(*[F.col(c) for c in many.columns if not many.schema[c].dataType.typeName().startswith("map")], F.lit(5)), F.lit(salts)).cast("int")
    dealt = many.where(is_hub(many_key)).withColumn("_salt", salt)
    copied = few.where(is_hub(few_key)).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    split = copied.join(dealt, (F.col(few_key) == F.col(many_key)) & (F.col("_copy") == F.col("_salt"))).drop("_copy", "_salt")
    return plain.unionByName(split)
