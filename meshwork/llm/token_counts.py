"""Token counts with a digest cache.

A text's count depends on its normalised content and on the tokenizer, so both are digested, the stored counts are joined
by the two digests, and only the distinct contents without a stored count are encoded and appended to the cache.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, in_arrow, kept, nothing, shared_dir, text_of

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"
#: Texts counted at a time.
SLICE = 256
APART = re.compile("(?<=[^ ]) (?=[^ ])")
#: How sentencepiece writes a space.
MARK = "▁"


def tokenizer_digest(path: str) -> str:
    """The tokenizer's version: a digest of its file and of the library that runs it."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.encode()).hexdigest()


class PieceCounter:
    """Counts by sentencepiece. A chunk between single spaces is encoded once and remembered.

    That is exact only if no piece crosses from a character into a following space mark, which the vocabulary shows, and
    if the text doesn't hold the mark itself, which reads as a space; texts that do, and all texts with any other
    vocabulary or where the model rewrites them, are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        probe = "a  b\tc ﬁ"
        self.apart = not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.encode(" x") != self.model.encode("x")
        self.apart = self.apart and self.model.decode(self.model.encode(probe)) == probe
        self.chunks = Memo(self.whole, nothing)

    def whole(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))

    def count(self, text: str) -> int:
        if not self.apart or MARK in text:
            return self.whole(text)
        single = "  " not in text and text[:1] != " " and text[-1:] != " "
        return sum(map(self.chunks.__getitem__, text.split(" ") if single else APART.split(text))) if text else 0

    def counts(self, texts: list[str]) -> list[int]:
        return [self.count(t) for t in texts]


class WordCounter:
    """Counts by a tokenizers file, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]


def counter(path: str) -> PieceCounter | WordCounter:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(("token_counts", path), partial(PieceCounter if path.endswith(".model") else WordCounter, path))


def encode_counts(misses: DataFrame, tokenizer_path: str, version: str) -> DataFrame:
    """(content, text) rows as rows of the cache, one each; texts must not be null, empty ones count 0, no rows give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                n = count.counts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("content"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["content", "tokenizer", "n_tokens"]
                )

    return in_arrow(misses.select("content", "text"), "token_counts", run, CACHE_SCHEMA)


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The stored counts; an empty table before the first run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, whole texts, by way of the cache at cache_path.

    Normalised content is the text with null read as empty: nothing else leaves every tokenizer's count unchanged. Empty
    texts have 0 tokens. Repeated texts are encoded once, also when a third of all rows repeat one: contents are grouped
    before their texts move. Repeated rows each have their row, extra columns are ignored, an empty table gives no rows.
    Without cache_path a cache of this run is kept in the shared folder. Runs that append at the same time may store a
    count twice; readers take one, and both are equal.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    cache_path = cache_path or f"{shared_dir(spark)}/meshwork/token_counts/{uuid.uuid4().hex}"
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("content"), text.alias("text"))

    def stored() -> DataFrame:
        own = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
        return own.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    distinct = rows.groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(stored(), "content", "left_anti")
    encode_counts(misses, tokenizer_path, version).write.mode("append").parquet(cache_path)
    lengths = rows.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    return lengths.join(stored(), "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
