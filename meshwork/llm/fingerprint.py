"""Homomorphic fingerprints of documents.

A document is the multiset of its paragraphs. Each paragraph is hashed to a wide vector, and a document's fingerprint is
the sum of its paragraphs' vectors modulo powers of two: the order of paragraphs doesn't matter, and inserting or
deleting one adds or subtracts its vector without reading the rest.

A vector has two parts. The first, 32 lanes modulo 2**64, is taken from an extendable hash of the paragraph's bytes: sums
of different multisets differ but for chance. The second, 256 lanes modulo 2**16, is the sum of random signs of the
paragraph's distinct word triples: what two documents don't share is what is left of the difference of their sums, so
the squares of its lanes estimate how much that is.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, in_arrow, kept, nothing, task_count, text_of
from .decontamination import joined, words_of

#: Lanes of 64 bits for equality, and lanes of 16 bits for likeness.
EXACT, SIGNS = 32, 256
#: Words of a unit of likeness.
RUN = 3
#: Units whose signs are summed at a time.
UNITS_AT_A_TIME = 8192
SALTS = np.random.default_rng(11).integers(0, 1 << 63, SIGNS // 64, dtype=np.uint64)


class Print(NamedTuple):
    """The sum of paragraphs' vectors. Lanes wrap around, as their types do."""

    exact: np.ndarray
    signs: np.ndarray

    def __add__(self, other: Print) -> Print:
        return Print(self.exact + other.exact, self.signs + other.signs)

    def __sub__(self, other: Print) -> Print:
        return Print(self.exact - other.exact, self.signs - other.signs)

    def to_bytes(self) -> bytes:
        return self.exact.astype("<u8").tobytes() + self.signs.astype("<i2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Print:
        return cls(np.frombuffer(data, "<u8", EXACT), np.frombuffer(data, "<i2", SIGNS, 8 * EXACT))

    def text(self) -> str:
        return base64.b64encode(self.to_bytes()).decode()


NOTHING = Print(np.zeros(EXACT, np.uint64), np.zeros(SIGNS, np.int16))


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) | 1


def paragraphs(text: str) -> list[str]:
    """The lines of a text, empty ones too, so that texts are equal up to the order of their lines or not at all; the empty
    text has none."""
    return text.split("\n") if text else []


def units(lines: list[str], hashes: dict[str, int]) -> np.ndarray:
    """Hashes of the distinct runs of RUN words of each line; a line of fewer words is one unit, one without words too."""
    flat: list[int] = []
    own: list[int] = []
    for line in lines:
        words = words_of(line)
        if len(words) >= RUN:
            flat += map(hashes.__getitem__, words)
            own.append(len(words))
        else:
            flat += [*map(hashes.__getitem__, words), *[0] * (RUN - len(words))] if words else [xxhash.xxh64_intdigest(line, 1), 0, 0]
            own.append(RUN)
    words_, lengths = np.array(flat, np.uint64), np.array(own, np.int64)
    key = np.zeros(max(0, len(words_) - RUN + 1), np.uint64)
    for j in range(RUN):
        key = joined(key, words_[j : len(words_) - RUN + 1 + j])
    line_of = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    inside = line_of[: len(key)] == line_of[RUN - 1 :]
    key, line_of = key[inside], line_of[: len(inside)][inside]
    return key[np.unique(joined(key, line_of), return_index=True)[1]]


def print_of(lines: list[str], hashes: dict[str, int] | None = None) -> Print:
    """The fingerprint of a multiset of paragraphs."""
    if not lines:
        return NOTHING
    seeds = b"".join(hashlib.shake_128(line.encode()).digest(8 * EXACT) for line in lines)
    exact = np.frombuffer(seeds, "<u8").reshape(-1, EXACT).sum(0, dtype=np.uint64)
    key = units(lines, Memo(word_hash, nothing) if hashes is None else hashes)
    ones = np.zeros(SIGNS, np.int64)
    for lo in range(0, len(key), UNITS_AT_A_TIME):
        part = key[lo : lo + UNITS_AT_A_TIME, None]
        words = joined(joined(part, SALTS), part)
        ones += np.add.reduce(np.unpackbits(words.view(np.uint8), axis=1), 0, dtype=np.uint16)
    return Print(exact, (2 * ones - len(key)).astype(np.int16))


def likeness(a: Print, b: Print) -> float:
    """An estimate of twice what two documents share by what they have in all, in word triples: 1 for equal ones, about 0 for
    unrelated ones, with a standard error of at most 0.09. Lanes of over 2**15 wrap around and blur it, which takes a
    line of a thousand words that is repeated a thousand times."""
    if (a.exact == b.exact).all():
        return 1.0
    x, y, z = (v.astype(np.float64) for v in (a.signs, b.signs, a.signs - b.signs))
    have = x @ x + y @ y
    return float(np.clip(1 - z @ z / have, 0, 1)) if have else 0.0


def word_memo() -> Memo:
    return kept("fingerprint", partial(Memo, word_hash, nothing))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint binary) of every row; null texts are empty. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_memo()
        for b in batches:
            prints = [print_of(paragraphs(t.as_py()), hashes).to_bytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.binary())], ["doc_id", "fingerprint"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return in_arrow(own, "fingerprint", run, "doc_id long, fingerprint binary")


def updated(prints: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """prints (doc_id, fingerprint) after paragraphs (doc_id, text), a row each, were inserted and deleted, without reading any
    document: documents without a fingerprint begin empty. Rows of one doc_id are summed, so prints of parts of a
    document, or of a source under one id, become that of the whole.

    Each batch is summed by doc_id before it moves, so a doc_id with a third of all rows sends one row for each batch.
    """
    parts = [prints.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("fingerprint"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("sign"))]
    for changes, sign in ((inserted, 1), (deleted, -1)):
        if changes is not None:
            parts.append(changes.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("fingerprint"), text_of().alias("text"), F.lit(sign).alias("sign")))
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)

    def emitted(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()), pa.array([p.to_bytes() for p in sums.values()], pa.binary())], ["doc_id", "fingerprint"])

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_memo()
        for b in batches:
            sums: dict[int | None, Print] = {}
            for doc, known, text, sign in zip(*(b.column(c).to_pylist() for c in ("doc_id", "fingerprint", "text", "sign")), strict=True):
                own = Print.from_bytes(known) if text is None else print_of([text], hashes)
                sums[doc] = sums.get(doc, NOTHING) + own if sign > 0 else sums.get(doc, NOTHING) - own
            yield emitted(sums)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by doc_id; the last one stays open from batch to batch."""
        open_: dict[int | None, Print] = {}
        for b in batches:
            done: dict[int | None, Print] = {}
            for doc, own in zip(b.column("doc_id").to_pylist(), b.column("fingerprint").to_pylist(), strict=True):
                if doc not in open_:
                    done |= open_
                    open_ = {doc: NOTHING}
                open_[doc] = open_[doc] + Print.from_bytes(own)
            yield emitted(done)
        if open_:
            yield emitted(open_)

    schema = "doc_id long, fingerprint binary"
    moved = in_arrow(rows, "fingerprint", changed, schema).repartition("doc_id").sortWithinPartitions("doc_id")
    return in_arrow(moved, "fingerprint", summed, schema)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, and that of its edit: the last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document, in the order of doc_id, after the last the first.

    The edit's fingerprint is the document's less the paragraphs from the cut on plus the new ones: paragraphs before the
    cut aren't hashed again. A null text is empty; an empty one has n_chars 0, the sum of nothing as its fingerprint and
    is at likeness 1 to empty ones and 0 to others. Documents without a doc_id come first; rows of one doc_id are
    documents of their own, in the order of a hash of their texts, and repeated rows have rows that are alike. A single
    document is its own next one. Extra columns are ignored, an empty table gives no rows. Very long texts are read whole.

    Documents move once: they are dealt into ranges of (doc_id, hash), whose starts, one for each task, come from a
    sort of these two columns alone, so that no id is too frequent for a range. The document that begins a range is sent
    to the end of the one before, too, and each range is read in order, two documents at a time.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    sorted_ids = own.select("doc_id", "h").repartitionByRange(task_count(docs.sparkSession), F.asc_nulls_first("doc_id"), "h")
    firsts = sorted_ids.groupBy(F.spark_partition_id().alias("task")).agg(F.min(F.struct("doc_id", "h")).alias("key")).select("key.*").collect()
    starts = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["h"]) for r in firsts)
    n = max(1, len(starts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_right(starts, (d is not None, d or 0, h)) - 1 for d, h in zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist(), strict=True)]
            is_first = [i for i, (d, h, k) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist(), at, strict=True)) if starts[k] == (d is not None, d or 0, h)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array([False] * len(at))], DEALT)
            if is_first:
                again = b.take(pa.array(is_first))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array([(at[i] - 1) % n for i in is_first], pa.int32()), pa.array([True] * len(is_first))], DEALT)

    dealt = in_arrow(own, "fingerprint", deal, "doc_id long, text string, h long, range int, is_next boolean")
    ordered = dealt.repartitionById(n, "range").sortWithinPartitions("range", "is_next", F.asc_nulls_first("doc_id"), "h", "text")
    return in_arrow(ordered, "fingerprint", edits, EDITED)


DEALT = ["doc_id", "text", "h", "range", "is_next"]


class Document:
    """A document's text and the sums of its paragraphs before and from the line on in which its second half begins."""

    def __init__(self, doc_id: int | None, text: str, hashes: Memo):
        self.doc_id, self.text = doc_id, text
        self.cut = len(text) - len(text) // 2
        self.line = text.rfind("\n", 0, self.cut) + 1
        self.before = print_of(text[: self.line - 1].split("\n"), hashes) if self.line else NOTHING
        self.whole = self.before + print_of(self.rest(text), hashes)

    def rest(self, text: str) -> list[str]:
        """The lines of a text that is this one up to the cut, from the cut's line on."""
        return text[self.line :].split("\n") if self.line else paragraphs(text)

    def edited(self, following: Document, hashes: Memo) -> tuple[str, Print]:
        text = self.text[: self.cut] + following.text[: len(self.text) // 2]
        return text, self.before + print_of(self.rest(text), hashes)

    def row(self, following: Document, hashes: Memo) -> tuple:
        text, changed = self.edited(following, hashes)
        digest = hashlib.sha256(text.encode()).hexdigest()
        return self.doc_id, len(self.text), digest, self.whole.text(), changed.text(), likeness(self.whole, changed), likeness(self.whole, following.whole)


def edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of EDITED of ranges in order: each document with the one after it, which at the end of a range is its is_next row."""
    hashes, last = word_memo(), None
    for b in batches:
        rows = []
        for doc_id, text, is_next in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("is_next").to_pylist(), strict=True):
            if is_next and last is None:
                continue  # a repeated row of the next range's first document
            now = Document(doc_id, text.as_py(), hashes)
            if last is not None:
                rows.append(last.row(now, hashes))
            last = None if is_next else now
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [f.split()[0] for f in EDITED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names)
