"""Algebra of fingerprints: arrays of 157 signed longs that hold 64 bits each. All are built-in column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BITS, LAST_MASK, WORDS


def masked(words: Column) -> Column:
    """The last word cut to its 16 bits."""
    return F.transform(words, lambda w, i: F.when(i == WORDS - 1, w.bitwiseAND(F.lit(LAST_MASK))).otherwise(w))


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.bit_count(w))


def bind(a: Column, b: Column) -> Column:
    """XOR, its own inverse."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def hamming(a: Column, b: Column) -> Column:
    """The number of different bits; 10,000 if either side is null."""
    return F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v), F.lit(BITS))


@F.pandas_udf(T.IntegerType())
def hamming_packed(a: pd.Series, b: pd.Series) -> pd.Series:
    """hamming() over binary prints in Arrow batches: the faster form for large corpora."""
    whole = a.notna() & b.notna()
    out = np.full(len(a), BITS)
    if whole.any():
        x, y = (np.frombuffer(b"".join(s[whole]), np.uint64).reshape(-1, WORDS) for s in (a, b))
        out[whole] = np.bitwise_count(x ^ y).sum(1)
    return pd.Series(out)


def similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / BITS


def most_distance(threshold: float) -> int:
    """The greatest distance whose similarity is at least threshold: bounds are compared as whole numbers."""
    return math.floor((1 - threshold) * BITS + 1e-9)


def bound_to(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used: it becomes a lambda's variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def permute(words: Column, shift: int) -> Column:
    """All 10,048 bits rotated to the left; shift may be negative, and 10,048 - shift undoes it."""
    shift %= 64 * WORDS
    whole, part = divmod(shift, 64)

    def turned(own: Column) -> Column:
        word = lambda i, back: F.get(own, F.pmod(i - whole - back, F.lit(WORDS)))
        if not part:
            return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: word(i, 0))
        turn = lambda i: F.shiftleft(word(i, 0), part).bitwiseOR(F.shiftrightunsigned(word(i, 1), 64 - part))
        return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), turn)

    return bound_to(words, turned)


def to_binary(words: Column) -> Column:
    """1,256 bytes, each word little-endian."""
    flip = lambda h: F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])
    return F.unhex(F.array_join(F.transform(words, lambda w: flip(F.lpad(F.hex(w), 16, "0"))), ""))


def from_binary(data: Column) -> Column:
    """The words of 1,256 bytes; shorter data is padded with zeros."""
    text = F.rpad(F.hex(data), 16 * WORDS, "0")
    word = lambda i: F.concat(*[F.substring(text, i * 16 + k, F.lit(2)) for k in range(15, 0, -2)])
    return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.conv(word(i), 16, -10).cast("long"))


def bound(df: DataFrame, words: str, *keys: str) -> DataFrame:
    """bind() of all prints of each group, as (keys, words). One row for each word and group leaves a task."""
    each = df.where(F.col(words).isNotNull()).select(*keys, F.posexplode(words).alias("i", "w"))
    return _gathered(each.groupBy(*keys, "i").agg(F.bit_xor("w").alias("w")), words, *keys)


#: Two counters of 32 bits to a long: bit j of a word counts in the lower half of long j, bit j + 32 in its upper half.
HALF, PAIR = 32, 0x0000000100000001


def counted(df: DataFrame, words: str, *keys: str) -> DataFrame:
    """(keys, i, n, counts): how many of a group's prints have each bit of word i, as 32 longs of two counters each.

    Counters are added as packed longs: masking a word by bits j and j + 32 gives an addend, so 32 sums a word count all
    its 64 bits. Spark adds them up in generated code before it shuffles, and a row for each word, not for each bit, is
    what moves. A group may have 2**31 - 1 prints. Null prints don't count.
    """
    each = df.where(F.col(words).isNotNull()).select(*keys, F.posexplode(words).alias("i", "w"))
    sums = [F.sum(F.expr(f"shiftrightunsigned(w, {j}) & {PAIR}L")).alias(f"c{j}") for j in range(HALF)]
    return each.groupBy(*keys, "i").agg(F.count("*").alias("n"), *sums).select(*keys, "i", "n", F.array(*[f"c{j}" for j in range(HALF)]).alias("counts"))


def bit_counts(counts: Column) -> Column:
    """The 64 counts of a word, from bit 0 on."""
    low = F.transform(counts, lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.concat(low, F.transform(counts, lambda c: F.shiftrightunsigned(c, HALF)))


def bundled(df: DataFrame, words: str, *keys: str) -> DataFrame:
    """The majority of each bit over a group's prints, ties to 0, as (keys, words). A group of any size is spread over all tasks."""
    bit = lambda c, j: F.when(2 * c > F.col("n"), F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))
    word = F.aggregate(F.transform(bit_counts(F.col("counts")), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return _gathered(counted(df, words, *keys).select(*keys, "i", word.alias("w")), words, *keys)


def sequenced(df: DataFrame, words: str, order: str, *keys: str) -> DataFrame:
    """Each group's prints permuted by their place and bundled. Places beyond the rotation's length wrap around."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    whole, part = F.floor(F.col("_at") / 64).cast("int"), (F.col("_at") % 64).cast("int")
    w = F.col(words)
    ring = lambda i: F.get(w, F.pmod(i, F.lit(WORDS)))
    low = lambda i: F.when(part == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", ring(i - whole - 1), 64 - part))
    turned = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.call_function("shiftleft", ring(i - whole), part).bitwiseOR(low(i)))
    placed = df.where(w.isNotNull()).withColumn("_at", F.pmod(place, F.lit(64 * WORDS)))
    return bundled(placed.withColumn(words, turned).select(*keys, words), words, *keys)


def _gathered(each: DataFrame, words: str, *keys: str) -> DataFrame:
    """Words back into arrays: 157 rows to a group."""
    pairs = F.array_sort(F.collect_list(F.struct("i", "w")))
    return each.groupBy(*keys).agg(F.transform(pairs, lambda p: p["w"]).alias(words))
