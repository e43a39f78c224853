"""Fingerprint functions under names that SQL can call."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BITS
from .bits import hamming_packed


@F.pandas_udf(T.DoubleType())
def similarity_packed(a: pd.Series, b: pd.Series) -> pd.Series:
    return 1 - hamming_packed.func(a, b) / BITS


def register_functions(spark: SparkSession) -> None:
    """hamming(a, b) and similarity(a, b) over binary prints; a null side is at distance 10,000."""
    spark.udf.register("hamming", hamming_packed)
    spark.udf.register("similarity", similarity_packed)
