"""N-gram Jaccard self-join with token-combination prefixes.

A document's tokens are the 64-bit hashes of its word shingles. Three steps find all links exactly (but for hash
collisions), without ever pairing off the members of a group:

1. Documents of equal sets are one class. Of each document the least tokens, a few more than two linked ones may differ
   in, are counted; a document too few of whose tokens occur in another class can have no link and is left out.
2. For the rest tokens are ordered: those of one class only, then rare ones, then frequent ones. A prefix is extended until
   it must share a signature with every linked document: rare tokens are signatures alone, frequent ones only in pairs of
   the same subclass.
3. Members of a signature are compared with a leader first, the one with the fewest tokens of its own, which joins the
   copies of one text without comparing them with one another. Who is outside the largest component after that is
   compared with those members with which it has tokens enough to share. Two documents that meet in frequent tokens only
   share no rare one, else they would meet in that too, so there only their frequent tokens count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, Scratch, give_back, in_arrow, kept, nothing, task_count, text_of
from .components import connected_components

#: Texts whose sets are made at a time.
SLICE = 64
#: Words of a Bloom filter that the driver reads at a time.
READ_WORDS = 1 << 16
#: Tokens below this make up a set's head, a quarter of it on average.
HEAD = -(1 << 62)
SIGN = np.uint64(1 << 63)


def word_hashes() -> Memo:
    return kept("ngram_join", partial(Memo, xxhash.xxh64_intdigest, nothing))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


#: Odd multipliers of a shingle's words, without a pattern, so that sums over other orders of the same words differ.
MULTIPLIERS = mixed(mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1)


def shingle_set(text: str, words: Memo, k: int) -> np.ndarray:
    """The sorted distinct hashes of all k-word shingles, or of the whole sequence if it is shorter; empty without words.

    bytes.lower() lowers A-Z only and bytes.split() parts at blank, tab, line feed to carriage return, nothing else.
    """
    h = np.array([words[w] for w in text.encode("utf-8", "surrogatepass").lower().split()], dtype=np.uint64)
    if len(h) < k:
        s = (h * MULTIPLIERS[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)) if len(h) else h
    else:
        s = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            s += h[j : len(h) - k + 1 + j] * MULTIPLIERS[j]
    return np.unique(mixed(s))


def may_differ(n: int, percent: int) -> int:
    """How many of its n tokens a document may hold that a linked one doesn't."""
    return n - -(-percent * n // 100)


def slack(n: int) -> int:
    return n // 10


def step_prefix(s: np.ndarray, percent: int) -> np.ndarray:
    return s[: may_differ(len(s), percent) + 1 + slack(len(s))]


def prefix_tokens(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(token, class): the least tokens of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_hashes()
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                sets = [shingle_set(t.as_py(), words, k) for t in b.column("text").slice(lo, SLICE)]
                least = [step_prefix(s, percent) for s in sets]
                marks = np.array([class_of(s) for s in sets], dtype=np.int64)
                tokens = np.concatenate(least).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(marks, [len(x) for x in least]))], ["token", "class"])

    return in_arrow(docs.select("text"), "ngram_join", run, "token long, class long")


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Bitmap:
    """A set of tokens as a Bloom filter of a bounded number of bits: it may hold more than was put in, never less.

    Tokens are hashes, so three stretches of their own bits are three places. The driver reads the bits in slices.
    """

    def __init__(self, scratch: Scratch, tokens: DataFrame, most_bits: int):
        self.log = max(12, min(most_bits.bit_length() - 1, (64 * tokens.count()).bit_length()))
        place = F.explode(F.array(*[F.shiftrightunsigned("token", shift).bitwiseAND(F.lit((1 << self.log) - 1)) for shift in self.shifts()]))
        bits = tokens.select(place.alias("place")).select(F.shiftright("place", 6).alias("w"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
        rows = scratch.written(bits.groupBy("w").agg(F.bit_or("bit").alias("bits")), "bits")
        self.words = np.zeros(1 << (self.log - 6), dtype=np.int64)
        for lo in range(0, len(self.words), READ_WORDS):
            part = rows.where((F.col("w") >= lo) & (F.col("w") < lo + READ_WORDS)).toPandas()
            self.words[part["w"].to_numpy()] = part["bits"].to_numpy()
        del part
        give_back()

    def shifts(self) -> list[int]:
        return [64 - self.log, (64 - self.log) // 2, 0]

    def holds(self, s: np.ndarray) -> np.ndarray:
        held = np.ones(len(s), dtype=np.uint64)
        for shift in self.shifts():
            place = (s >> np.uint64(shift)) & np.uint64((1 << self.log) - 1)
            held &= self.words.view(np.uint64)[place >> np.uint64(6)] >> (place & np.uint64(63))
        return held & np.uint64(1)


def arrays_of(sets: list[np.ndarray | None]) -> pa.Array:
    """Sets as arrays of signed longs in their order, None as null."""
    bounds = np.cumsum([0, *(0 if s is None else len(s) for s in sets)], dtype=np.int32)
    values = np.concatenate([np.zeros(0, np.uint64), *(s for s in sets if s is not None)])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array((values ^ SIGN).view(np.int64)), mask=pa.array([s is None for s in sets]))


def sets_of(arrays: pa.ListArray) -> list[np.ndarray]:
    """arrays_of's inverse, without nulls."""
    bounds, values = arrays.offsets.to_numpy(), arrays.flatten().to_numpy().view(np.uint64) ^ SIGN
    return [values[a:b] for a, b in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0], strict=True)]


def classed(docs: DataFrame, shared: Bitmap, k: int, percent: int) -> DataFrame:
    """(doc_id, n, class, tokens): tokens as an array if the document may have a link, else null; class null without words."""
    sent = docs.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = word_hashes(), sent.value
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                sets = [shingle_set(t.as_py(), words, k) for t in part.column("text")]
                # a linked document may be shorter, and share no more than its own slack lets it
                able = [len(s) and bits.holds(step_prefix(s, percent)).sum() > slack(-(-percent * len(s) // 100)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                        arrays_of([s if a else None for s, a in zip(sets, able, strict=True)]),
                    ], ["doc_id", "n", "class", "tokens"],
                )

    return in_arrow(docs, "ngram_join", run, "doc_id long, n long, class long, tokens array<long>")


def size_bands(n: int) -> list[int]:
    """The numbers of subclasses under which a document of n tokens pairs its frequent ones; 0: each stands alone.

    Two linked documents have a number in common: sizes fall into octaves from 50 on, and whoever may be linked with the
    octave below, pairs as that does too.
    """
    octave = max(0, (n // 50).bit_length())
    bands = [octave] + ([octave - 1] if octave and 4 * n < 5 * (50 << (octave - 1)) else [])
    return [0 if not o else (50 << (o - 1)) // 5 for o in bands]


def signatures_of(tokens: np.ndarray, frequent: np.ndarray, lone: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures, of rare tokens and of frequent ones, of the shortest prefix that keeps one, whichever tokens a linked
    document lacks. Where it holds frequent tokens, it holds all rare ones.

    lone: tokens of no other class, which every linked document lacks.
    """
    s, frequent = tokens[~lone], frequent[~lone]
    need = may_differ(len(tokens), percent) + 1 - int(lone.sum())
    if need <= 0:
        return s[:0], s[:0]
    rare, often = s[~frequent], s[frequent]
    lacking, out = need - len(rare), [s[:0]]
    for g in size_bands(len(tokens)) if lacking > 0 else ():
        if not g:
            out.append(often[:lacking])
            continue
        sub = (mixed(often) % np.uint64(g)).astype(np.int64)
        order = np.argsort(sub, kind="stable")
        first = np.zeros(len(sub), dtype=bool)  # the first token of each subclass adds nothing by itself
        first[np.unique(sub, return_index=True)[1]] = True
        end = int(np.searchsorted(np.cumsum(~first), lacking)) + 1
        if end > len(often):  # all tokens together don't suffice in pairs: such short prefixes take them alone
            out.append(often)
            end = len(often)
        order = order[order < end]
        for lag in range(1, len(order)):
            a, b = order[:-lag], order[lag:]
            same = sub[a] == sub[b]
            if not same.any():
                break
            out.append(mixed(often[a[same]] * MULTIPLIERS[1] + often[b[same]] * MULTIPLIERS[2] + np.uint64(g)))
    return rare[:need], np.unique(np.concatenate(out))


def signature_rows(sets: DataFrame, frequent: list[DataFrame], repeated: Bitmap, percent: int) -> DataFrame:
    """(signature, class, n, c): c is the number of tokens that may be shared with who has the signature too: of the frequent
    ones if it is of these, else of those that any other class holds.

    frequent: the frequent tokens in blocks of bounded size, each broadcast in its own pass.
    """
    spark = sets.sparkSession
    marked = sets.select("class", "n", "tokens", F.lit(None).cast("binary").alias("frequent"))
    for block in frequent:
        sent_block = spark.sparkContext.broadcast(np.sort(block.toPandas()["token"].to_numpy(dtype=np.int64).view(np.uint64) ^ SIGN))

        def mark(batches: Iterator[pa.RecordBatch], sent: object = sent_block) -> Iterator[pa.RecordBatch]:
            often = sent.value
            for b in (part.slice(lo, SLICE) for part in batches for lo in range(0, part.num_rows, SLICE)):
                out = []
                for s, f in zip(sets_of(b.column("tokens")), b.column("frequent").to_pylist(), strict=True):
                    place = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    out.append((np.frombuffer(f or bytes(len(s)), bool) | (often[place] == s)).tobytes())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("class", "n", "tokens")), pa.array(out, pa.binary())], ["class", "n", "tokens", "frequent"])

        marked = in_arrow(marked, "ngram_join", mark, "class long, n long, tokens array<long>, frequent binary")
    sent_bits = spark.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent_bits.value
        for b in (part.slice(lo, SLICE) for part in batches for lo in range(0, part.num_rows, SLICE)):
            own, count, n_common = [], [], []
            for s, f in zip(sets_of(b.column("tokens")), b.column("frequent").to_pylist(), strict=True):
                lone, often = bits.holds(s) == 0, np.frombuffer(f or bytes(len(s)), bool)
                rare_ones, frequent_ones = signatures_of(s, often, lone, percent)
                own += [rare_ones, frequent_ones]
                count.append(len(rare_ones) + len(frequent_ones))
                n_common += [len(s) - int(lone.sum())] * len(rare_ones) + [int(often.sum())] * len(frequent_ones)
            ids = (np.repeat(b.column(x).to_numpy(), count) for x in ("class", "n"))
            rows = [np.concatenate(own).view(np.int64), *ids, np.array(n_common, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows)], ["signature", "class", "n", "c"])

    return in_arrow(marked, "ngram_join", run, "signature long, class long, n long, c long")


def with_sides(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    side = lambda x: sets.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col(column).alias(f"{column}_{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a")


def common(column: str) -> Column:
    return F.size(F.array_intersect(f"{column}_a", f"{column}_b"))


def distinct_groups(rows: DataFrame) -> DataFrame:
    """rows without the groups that have the same members as another one: shared passages have many signatures alike."""
    own = rows.groupBy("signature").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("class", "c")).alias("x"), F.bit_xor(F.xxhash64("c", "class")).alias("y"))
    one = own.where("m > 1").groupBy("m", "x", "y").agg(F.min("signature").alias("signature"))
    return rows.join(one.select("signature"), "signature", "left_semi")


class Links:
    """The links found so far and the components they make."""

    def __init__(self, scratch: Scratch, sets: DataFrame, percent: int):
        self.scratch, self.sets, self.percent = scratch, sets, percent
        self.found: list[DataFrame] = []
        self.label: DataFrame | None = None

    def named(self, rows: DataFrame) -> DataFrame:
        """rows with `of`, the component of their class."""
        if self.label is None:
            return rows.withColumn("of", F.col("class"))
        return rows.join(self.label, "class", "left").withColumn("of", F.coalesce("component", "class")).drop("component")

    def able(self, n_a: Column, c_a: Column, n_b: Column, c_b: Column) -> Column:
        """Whether two sets of n tokens, c of them also held by others, may be linked."""
        return (100 + self.percent) * F.least(c_a, c_b) >= self.percent * (n_a + n_b)

    def compare(self, pairs: DataFrame) -> bool:
        """Keeps the links among (a, b) rows, which may repeat; whether there are any. Heads come first: they show for most
        others that they are less similar."""
        own = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        enough = lambda c: (100 + self.percent) * c >= self.percent * (F.col("n_a") + F.col("n_b"))
        above = F.least(F.col("n_a") - F.size("head_a"), F.col("n_b") - F.size("head_b"))
        open_pairs = with_sides(own, self.sets, "head").where(enough(common("head") + above)).select("a", "b")
        met = with_sides(self.scratch.written(open_pairs, "open_pairs"), self.sets, "tokens")
        new = self.scratch.written(met.where(enough(common("tokens"))).select("a", "b"), "links")
        if new.isEmpty():
            return False
        self.found.append(new)
        return True

    def relabel(self) -> None:
        """Brings the components up to the links found."""
        if self.found:
            label = connected_components(reduce(DataFrame.unionByName, self.found), "a", "b")
            self.label = label.withColumnRenamed("node", "class")

    def open_groups(self, rows: DataFrame, number: int) -> DataFrame:
        """(signature, lead, lead_n, lead_c, lead_of) of the groups that hold several components; lead is the class of the
        largest one, or of all if none is larger, with the fewest tokens of its own, after the first round any other."""
        order = F.struct((F.col("n") - F.col("c") if number == 0 else F.lit(0).cast("long")).alias("own"), F.xxhash64("class", F.lit(number)).alias("mark"))
        least = F.min(F.struct(order.alias("order"), F.col("class").alias("lead"), F.col("n").alias("lead_n"), F.col("c").alias("lead_c")))
        parts = self.named(rows).groupBy("signature", "of").agg(F.count("*").alias("m"), least.alias("least"))
        best = F.min(F.struct((-F.col("m")).alias("m"), "least", F.col("of").alias("lead_of")))
        groups = parts.groupBy("signature").agg(best.alias("best"), F.count("*").alias("parts")).where("parts > 1")
        return groups.select("signature", "best.least.lead", "best.least.lead_n", "best.least.lead_c", "best.lead_of")

    def star(self, rows: DataFrame, number: int) -> bool:
        """Compares the outsiders of open groups with a leader of the largest component; whether that linked any."""
        may = self.able(F.col("n"), F.col("c"), F.col("lead_n"), F.col("lead_c"))
        led = self.named(rows).join(self.open_groups(rows, number), "signature").where((F.col("of") != F.col("lead_of")) & may)
        return self.compare(led.select(F.col("lead").alias("a"), F.col("class").alias("b")))

    def outside(self, rows: DataFrame) -> None:
        """Compares the outsiders of open groups with all members that aren't linked with them yet and may be."""
        left = self.named(rows).join(self.open_groups(rows, 0).select("signature", "lead_of"), "signature")
        left = self.scratch.written(left, "left")
        other = left.where(F.col("of") != F.col("lead_of")).select("signature", *[F.col(c).alias(f"{c}_a") for c in ("class", "n", "c", "of")])
        # of two outsiders one row is enough
        once = (F.col("of") == F.col("lead_of")) | (F.col("class") < F.col("class_a"))
        may = self.able(F.col("n"), F.col("c"), F.col("n_a"), F.col("c_a"))
        self.compare(left.join(other, "signature").where((F.col("of") != F.col("of_a")) & once & may).select(F.col("class_a").alias("a"), F.col("class").alias("b")))


def find_links(rows: DataFrame, links: Links, rounds: int) -> DataFrame | None:
    """(class, component) of all links among the members of a signature, None if there are none; rounds changes the work only."""
    rows = links.scratch.written(distinct_groups(rows), "groups")
    for number in range(rounds):
        if not links.star(rows, number):
            break
        links.relabel()
    links.outside(rows)
    links.relabel()
    return links.label


def jaccard_components(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    frequent_from: int = 64,
    rounds: int = 1,
    most_bits: int = 1 << 25,
    block: int = 250_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the least doc_id reachable by links of at least percent / 100.

    A-Z are lowered and words parted at ASCII white space; a document of fewer than k words has one shingle, one without
    words (null and empty texts too) none, and no link. Repeated rows each have their row and are linked. Extra columns
    are ignored, an empty table gives no rows. frequent_from is the number of classes from which on a token is frequent; it
    and rounds change the work, never the result. percent must be over 50.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    with Scratch(spark) as scratch:
        ends = prefix_tokens(read, k, percent).groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
        shared = scratch.written(ends.where(F.col("lo") != F.col("hi")).select("token"), "shared")
        held = scratch.written(classed(read, Bitmap(scratch, shared, most_bits), k, percent), "classes")
        of_class = held.where(F.col("tokens").isNotNull()).groupBy("class").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
        head = F.filter("tokens", lambda t: t < HEAD)
        sets = scratch.bucketed(of_class.withColumn("head", head), "sets", "class", task_count(spark))

        counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        counts = scratch.written(counts.where("n > 1"), "repeated")
        often = counts.where(F.col("n") >= frequent_from).select("token")
        n_blocks = -(-often.count() // block)
        blocks = [often.where(F.pmod(F.xxhash64("token"), F.lit(n_blocks)) == i) for i in range(n_blocks)]
        repeated = Bitmap(scratch, counts.select(F.col("token").bitwiseXOR(F.lit(-(1 << 63))).alias("token")), most_bits)
        rows = scratch.written(signature_rows(sets, blocks, repeated, percent), "signatures")
        label = find_links(rows, Links(scratch, sets, percent), rounds)

        joined = held.select("doc_id", "n", "class")
        joined = joined.withColumn("of", F.col("class")) if label is None else joined.join(label, "class", "left").withColumn("of", F.coalesce("component", "class"))
        joined = scratch.written(joined.select("doc_id", "n", "of"), "joined", keep=True)
    least = joined.where(F.col("of").isNotNull()).groupBy("of").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("m")).where("m > 1")
    return joined.join(least.select("of", "component_id"), "of", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
