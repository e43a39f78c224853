"""Text chunking: windows of characters and of tokens, and packing of paragraphs and sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_windows(tokens: Column, size: int = 256, overlap: int = 32) -> Column:
    """Arrays of `size` tokens, each beginning `overlap` before the last one's end; the last one ends with the tokens."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    n, step = F.size(tokens), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int")) * step
    return F.when(n == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.slice(tokens, i + 1, size)))


def chunk_tokens(df: DataFrame, id_col: str, text_col: str, size: int = 256, overlap: int = 32) -> DataFrame:
    """(id, chunk_no, n_tokens, chunk): tokens are what stands between blanks; null and blank texts have no chunks."""
    tokens = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda t: t != "")
    rows = df.select(id_col, F.explode(F.array(tokens)).alias("tokens"))
    windows = rows.select(id_col, F.posexplode(token_windows(F.col("tokens"), size, overlap)).alias("chunk_no", "w"))
    return windows.select(id_col, "chunk_no", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("chunk"))


def fixed_windows(df: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """(id, chunk_no, chunk): hard cuts of `size` characters, `overlap` shared."""
    n, step = F.length(text_col), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int")) * step
    starts = df.where(n > 0).select(id_col, text_col, F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("chunk_no", "at"))
    return starts.select(id_col, "chunk_no", F.substring(F.col(text_col), F.col("at") + 1, F.lit(size)).alias("chunk"))


def split_text(text: str, size: int = 512, overlap: int = 64, separator: str = "\n") -> list[str]:
    """Chunks of at most size characters that end at the last separator in reach, else at a hard cut; starts always advance.

    A text of no more than size characters is one chunk, an empty one too.
    """
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            cut = text.rfind(separator, start, end)
            end = cut + len(separator) if cut > start else end
        out.append(text[start:end])
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def pack_paragraphs(text: str, least: int = 100, most: int = 1000) -> list[str]:
    """Paragraphs, parted by blank lines, packed up to `most` characters with a blank line after each.

    A paragraph that doesn't fit any more closes a chunk of at least `least` characters and begins the next one, however
    long it is. Where the chunk so far is shorter, a paragraph of at most `most` characters takes its place; of a longer
    one the sentences are packed, with a blank after each, onto what there is. Chunks under `least` are dropped.
    """
    out: list[str] = []
    held = ""

    def close() -> None:
        if held and len(held) >= least:
            out.append(held.strip())

    for p in re.split(r"\n\n+", text):
        if len(held) + len(p) > most and len(p) > most and (not held or len(held) < least):
            for sentence in re.split(r"(?<=[.!?])\s+", p):
                if len(held) + len(sentence) > most:
                    close()
                    held = ""
                held += f"{sentence} "
            continue
        if len(held) + len(p) > most:
            close()
            held = ""
        held += f"{p}\n\n"
    close()
    return out


def chunk_text(df: DataFrame, id_col: str, text_col: str, semantic: bool = False, **how: object) -> DataFrame:
    """(id, chunk_no, chunk) by split_text, or by pack_paragraphs if semantic; a null text has no chunks."""
    cut = pack_paragraphs if semantic else split_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, c) for i, t in zip(b[id_col], b[text_col], strict=True) for n, c in enumerate(cut(t, **how) if t is not None else [])]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_no", "chunk"])

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {dict(df.dtypes)[id_col]}, chunk_no int, chunk string")
