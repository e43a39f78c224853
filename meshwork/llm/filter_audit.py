"""How filters interact: what each removes, alone, after others, and by its Shapley value.

A document fails a set of filters, its mask. Let x_i say whether filter i is applied. The number of removed documents is the
multilinear polynomial R(x) = sum over non-empty sets T of (-1)**(|T| + 1) c_T prod of x_i over T, where c_T documents fail
all of T. Its corners are the numbers removed by sets of filters, whatever their order, so survivors of any prefix of any
order are evaluations. The Shapley value of filter i is the integral of its partial derivative along the diagonal.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, text_of

#: The filters, bit i of a mask is the i-th.
FILTERS = "ABCDE"
#: Bounds of the filters: least words, distinct words of 100, capitals of 100 code points.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
MARKS = re.compile(rb"[#$%&*|]")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


class RemovalPolynomial:
    """Made from c_T, the documents that fail all filters of T: c[0] are all documents."""

    def __init__(self, failing_all: Sequence[int]):
        self.n = failing_all[0]
        self.terms = {t: (-1) ** (t.bit_count() + 1) * c for t, c in enumerate(failing_all) if t}

    def removed(self, applied: int) -> int:
        """At a corner: terms of filters that aren't applied vanish."""
        return sum(c for t, c in self.terms.items() if t & applied == t)

    def survivors(self, applied: int) -> int:
        return self.n - self.removed(applied)

    def derivative(self, i: int) -> list[int]:
        """The coefficients, by powers of t, of the derivative by x_i where all x are t."""
        powers = [0] * max(t.bit_length() for t in self.terms)
        for t, c in self.terms.items():
            if t >> i & 1:
                powers[t.bit_count() - 1] += c
        return powers

    def shapley(self, i: int) -> Fraction:
        """The derivative integrated from 0 to 1."""
        return sum((Fraction(c, p + 1) for p, c in enumerate(self.derivative(i))), Fraction(0))


def text_masks(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, digest, mask): the filters that look at one text alone, and a 128-bit digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, masks, digests = pc.utf8_length(b.column("text")).to_pylist(), [], []
            for n_points, value in zip(points, b.column("text").cast(pa.binary()), strict=True):
                text = value.as_py()
                words = text.split()  # of bytes: at blanks and \t \n \v \f \r only
                capitals = len(text) - len(text.translate(None, CAPITALS))
                fails = len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * capitals > MOST_CAPITALS * n_points, MARKS.search(text) is not None
                masks.append(sum(f << i for i, f in enumerate(fails)))
                digests.append(hashlib.blake2b(text, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], ["doc_id", "part", "digest", "mask"])

    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), part.alias("part"), text_of(text_col).alias("text"))
    return in_arrow(own, "filter_audit", run, "doc_id long, part string, digest binary, mask int")


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) with the mask of all five filters.

    Copies are counted by (text, part, labels) where they are read, so a text that is a third of all rows moves as a few
    rows: all of them fail E but those with the least doc_id, which each of these groups counts, too.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    each = masks.join(known, "doc_id", "left").fillna(0, ["good", "toxic"])
    # rows of one doc_id are counted first: of the least one, all stay
    each = each.groupBy("digest", "part", "good", "toxic", "mask", "doc_id").agg(F.count("*").alias("n"))
    groups = each.groupBy("digest", "part", "good", "toxic", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnumbered"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"),
    )
    first = groups.groupBy("digest").agg(F.min("least").alias("first"))
    stay = F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0) + F.col("unnumbered")
    split = groups.join(first, "digest").withColumn("stay", stay).select(
        "part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("stay").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))).alias("x")
    )
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic")
    )


def audit_rows(part: str, all_: Sequence[int], good: Sequence[int], toxic: Sequence[int], alone: Sequence[int]) -> Iterator[dict]:
    """A row for each order and step, from the polynomials of all, good and toxic documents. alone: by filter, what fails it only."""
    r, q, x = map(RemovalPolynomial, (all_, good, toxic))
    orders = math.factorial(len(FILTERS))
    values = [orders * r.shapley(i) for i in range(len(FILTERS))]
    assert all(v.denominator == 1 for v in values), "a whole number of removals over all orders"
    for order in permutations(range(len(FILTERS))):
        applied = 0
        for step, i in enumerate(order, 1):
            before, applied = applied, applied | 1 << i
            removed = r.removed(applied) - r.removed(before)
            yield {
                "part": part, "filter_order": "".join(FILTERS[k] for k in order), "step": step, "kept": r.survivors(applied), "removed": removed, "redundant": all_[1 << i] - removed,
                "unique_fails": alone[i], "good_lost": q.removed(applied) - q.removed(before), "toxic_lost": x.removed(applied) - x.removed(before), "shapley": int(values[i]),
            }


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    Words are runs without blanks and \\t \\n \\v \\f \\r. A fails under 200 words, B with fewer distinct words than half of its
    words, C with capitals A-Z at over 2 in 100 code points, D with any of #$%&*|, E with a text that a smaller doc_id has,
    in whatever part. Texts are read once, whole; equal texts are told by 128-bit digests. Null texts are empty and parts
    that are null are ''. Empty texts fail A alone, and E but for the smallest doc_id. Rows without a doc_id are no
    smaller one's, fail E never and have no labels. Rows of one doc_id are counted each and aren't copies of one another;
    several labels of one doc_id hold together. Extra columns are ignored; an empty table has no parts and gives no rows.
    """
    counts = mask_counts(text_masks(docs, id_col, text_col, part_col), labels)
    sets = range(1 << len(FILTERS))
    failing = lambda c: F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(t)) == t, F.col(c)).otherwise(0)) for t in sets]).alias(c)
    alone = F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(len(FILTERS))]).alias("alone")
    parts = counts.groupBy("part").agg(failing("n"), failing("good"), failing("toxic"), alone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in COUNTS)])
        for b in batches:
            for p in b.to_pylist():
                yield pa.RecordBatch.from_pylist(list(audit_rows(p["part"], p["n"], p["good"], p["toxic"], p["alone"])), schema)

    return in_arrow(parts, "filter_audit", run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
