"""Table functions that SQL can call: chunkers of texts, and runs of ordered rows.

SELECT * FROM chunk_text(TABLE(documents), 'doc_id', 'text', 512, 64)
SELECT * FROM chunk_tokens(TABLE(documents), 'doc_id', 'text', 256, 32)
SELECT * FROM runs_of(TABLE(readings) PARTITION BY sensor ORDER BY (at), 'sensor', 'value')

They take whole tables or subqueries; columns are named by constants, and the id column keeps its name and type.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, SelectedColumn, udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from ..operators.text import pack_paragraphs, split_text



def table_column(table: AnalyzeArgument, name: AnalyzeArgument, what: str) -> str:
    """The name of a column that a constant argument names."""
    if not table.isTable:
        raise ValueError("the first argument must be a table: TABLE(name) or TABLE(SELECT ...)")
    if name.value is None or name.value not in table.dataType.names:
        raise ValueError(f"{what} must name a column of the table, of {', '.join(table.dataType.names)}")
    return name.value


def whole(argument: AnalyzeArgument | None, default: int, least: int, what: str) -> int:
    value = default if argument is None else argument.value
    if not isinstance(value, int) or value < least:
        raise ValueError(f"{what} must be a whole number of at least {least}")
    return value


def chunk_result(table: AnalyzeArgument, id: AnalyzeArgument, text: AnalyzeArgument, *more: tuple[str, object]) -> AnalyzeResult:
    """id, chunk_no, more and chunk; only the two columns reach the function."""
    names = table_column(table, id, "id"), table_column(table, text, "text")
    schema = StructType().add(names[0], table.dataType[names[0]].dataType).add("chunk_no", IntegerType())
    for name, kind in more:
        schema = schema.add(name, kind)
    return AnalyzeResult(schema.add("chunk", StringType()), select=[SelectedColumn(n) for n in dict.fromkeys(names)])


class ChunkText:
    """Chunks of at most size characters that overlap and end at a separator where one is in reach; with semantic, packed paragraphs
    of overlap to size characters. Null texts have none."""

    @staticmethod
    def analyze(table: AnalyzeArgument, id: AnalyzeArgument, text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, semantic: AnalyzeArgument | None = None) -> AnalyzeResult:
        if whole(overlap, 64, 0, "overlap") >= whole(size, 512, 1, "size"):
            raise ValueError("overlap must be less than size")
        return chunk_result(table, id, text)

    def eval(self, table: Row, id: str, text: str, size: int = 512, overlap: int = 64, semantic: bool = False) -> Iterator[tuple]:
        if table[text] is not None:
            for n, chunk in enumerate(pack_paragraphs(table[text], overlap, size) if semantic else split_text(table[text], size, overlap)):
                yield table[id], n, chunk


class ChunkTokens:
    """Windows of size tokens, parted by blanks, that overlap; the last one ends with the text. Null and blank texts have none."""

    @staticmethod
    def analyze(table: AnalyzeArgument, id: AnalyzeArgument, text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if whole(overlap, 32, 0, "overlap") >= whole(size, 256, 1, "size"):
            raise ValueError("overlap must be less than size")
        return chunk_result(table, id, text, ("n_tokens", IntegerType()))

    def eval(self, table: Row, id: str, text: str, size: int = 256, overlap: int = 32) -> Iterator[tuple]:
        tokens = (table[text] or "").split()
        for n, at in enumerate(range(0, max(0, len(tokens) - size) + (size - overlap), size - overlap) if tokens else ()):
            own = tokens[at : at + size]
            yield table[id], n, len(own), " ".join(own)
            if at + size >= len(tokens):
                break


class RunsOf:
    """(key, run, value, run_length) of rows in order, for a table with PARTITION BY key and ORDER BY: equal values in a row are
    one run, nulls too. Rows are read as a stream, of which one run is kept."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        names = table_column(table, key, "key"), table_column(table, value, "value")
        schema = StructType().add(names[0], table.dataType[names[0]].dataType).add("run", LongType())
        return AnalyzeResult(schema.add(names[1], table.dataType[names[1]].dataType).add("run_length", LongType()))

    def __init__(self) -> None:
        self.run, self.held = 0, None

    def eval(self, table: Row, key: str, value: str) -> Iterator[tuple]:
        now = table[key], table[value]
        if self.held is not None and self.held[0] == now:
            self.held[1] += 1
            return
        if self.held is not None:
            yield self.closed()
        self.held = [now, 1]

    def closed(self) -> tuple:
        self.run += 1
        return self.held[0][0], self.run, self.held[0][1], self.held[1]

    def terminate(self) -> Iterator[tuple]:
        if self.held is not None:
            yield self.closed()


def register_table_functions(spark: SparkSession) -> None:
    """chunk_text, chunk_tokens and runs_of for the session's SQL."""
    for name, handler in (("chunk_text", ChunkText), ("chunk_tokens", ChunkTokens), ("runs_of", RunsOf)):
        spark.udtf.register(name, udtf(handler))
