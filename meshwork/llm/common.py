"""Helpers that the operators of this folder share: inputs, text columns, what workers remember."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, shared_dir, written

__all__ = ["Memo", "Scratch", "ascii_lower", "in_arrow", "kept", "nothing", "shared_dir", "table", "task_count", "text_of", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of memory that a worker's memo may take, and what an entry takes besides its content.
MEMO_BYTES, ENTRY_BYTES = 32 << 20, 160
#: Bytes of a batch that is handed to a worker.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed, so that offsets and other alphabets stay as they are."""
    return F.translate(text, UPPER, LOWER)


class Memo(dict):
    """A memo of bounded memory: values are made by `make` and remembered in two halves. When the newer one is full, the older
    one goes, so that what is met often stays.

    Keys longer than `longest` are made each time: they hardly repeat.
    """

    def __init__(self, make: Callable[[Any], Any], size: Callable[[Any], int] = len, longest: int = 64, most: int = MEMO_BYTES):
        super().__init__()
        self.make, self.size, self.longest, self.half, self.held = make, size, longest, most // 2, 0
        self.older: dict[Any, Any] = {}

    def __missing__(self, key: Any) -> Any:
        value = self.older[key] if key in self.older else self.make(key)
        if len(key) <= self.longest:
            self.held += ENTRY_BYTES + len(key) + self.size(value)
            if self.held > self.half:
                self.older = dict(self)
                self.clear()
                self.held = ENTRY_BYTES
            self[key] = value
        return value


def nothing(_: Any) -> int:
    return 0


_kept: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What a worker keeps from task to task (a tokenizer, a memo): one thing only, the next operator's takes its place."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def in_arrow(df: DataFrame, name: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow for texts and sets, in batches of bounded bytes. name is the first part of what the task keeps.

    Workers serve one operator after the other, so what the last one kept goes at the beginning of a task, and memory that
    a task has freed goes back to the machine at its end.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(name)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def keep_only(name: str) -> None:
    """Drops what the worker keeps for other operators."""
    if any((k if isinstance(k, str) else k[0]) != name for k in _kept):
        _kept.clear()
        give_back()


def give_back() -> None:
    """Returns freed memory to the machine, as far as Arrow and the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)
