"""The corpus pipeline: documents in, packed training sequences out. Part of the llm subpackage; goes where it goes.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept, and its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents, with extra columns as they were, whatever
their names. In all stages null texts count as empty ones, an empty table stays empty, and rows without a doc_id, which
can't be told apart, are kept. Repeated rows of one doc_id are one document: they go or stay together.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.common import Scratch, table, written
from meshwork.llm.decontamination import contaminated
from meshwork.llm.line_dedup import dedup_lines
from meshwork.llm.ngram_join import jaccard_components
from meshwork.llm.packing import pack
from meshwork.llm.toxicity import score_toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id isn't in ids; rows without a doc_id can't be told apart and stay."""
    return docs.join(ids.select(F.col("doc_id")).distinct(), "doc_id", "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored toxic, at 0.3 or more, go. Null and empty texts have the score of texts without any sign of
    toxicity and stay; equal texts score alike. Without labels the fixed lexicon decides."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return without(docs, written(scored.where("predicted = 1").select("doc_id"), "toxic"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and similar lines of at least 16 characters one stays, the first by doc_id and line number; documents that lose
    all their lines go. n_chars follows the text. Null, empty and very short texts have no line to lose and stay."""
    return dedup_lines(docs, exact_from=16).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays, its repeated rows too. Null and empty texts
    are like nothing and stay."""
    return without(docs, written(jaccard_components(docs).where("doc_id <> component_id").select("doc_id"), "near"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edited by up to a quarter, go. Null and empty texts hold none; without a benchmark
    all stay."""
    return without(docs, written(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id"), "leaks"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences. Null and empty texts are an end id alone; each repeated row is packed; documents of
    equal length take their places by row numbers."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_join", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: Learned scores, MinHash, LSH and tokenizers are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the whole table; the pieces that packing returns, none of an empty table. A stage's
    table goes once the next one's is stored."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        now = Scratch(spark)
        docs = now.written(stage(spark, docs, sf_dir), name)
        if before:
            before.clear()
        before = now
    return docs
