"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

A line's shingles are all its stretches of `chars` characters, one at every character. Equal lines share a key; the
signature of a key is the least of its shingles' hashes under each of several xors. Keys that agree in a band of the
signature are candidates. Within a band they are compared with a leader first, which joins the copies of one line without
comparing them with one another. Bands that hold lines of several components after that are compared pair by pair if they
are of bounded size: bitmaps of the shingle sets travel with the rows, and the bits in which two differ are a lower bound of
the shingles they don't share, so hardly a pair that isn't similar goes further than the join that makes it, and no similar
one is lost. The larger ones are split by further rows of the signature, in as many ways as make hardly any loss, and what
is large still is compared wherever lines share one of their rarest shingles, as all similar lines do. Candidates are
verified by the exact Jaccard similarity of their shingle sets, arrays that are intersected, and union-find joins them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, task_count, text_of
from .components import connected_components

#: Bands of so many members at most are compared pair by pair: a member meets half as many bitmaps, which costs less than
#: the ten rows that a split makes of it.
FEW_MEMBERS = 512
#: Words of 64 bits of a line's bitmap: one in five bits is set for a line of about 1,000 characters, so that hardly a difference hides another.
BITMAP_WORDS = 64
#: Shingles hashed to a row: they are reduced among each other before they are aggregated.
STRIDE = 16
#: Hashes of a signature of which the sketch keeps four bits each.
SKETCHED = 32
#: Rows of the signature by which large bands are split.
SPLIT_ROWS = 3
#: White space besides the blank, as in a pattern's class.
WHITE = r"\t\n\x0b\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What a line with such white space holds: characters, and the two bytes with which those of general punctuation begin.
SIGNS, SIGN_BYTES = ["  ", *"\t\r\x0b\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u205f\u3000"], b"\xe2\x80"


def normal_line(line: Column) -> Column:
    """Lower case, each run of white space one blank, none at either end.

    Patterns are slow, so only lines that hold a sign of other white space meet one.
    """
    signs = [F.contains(line, F.lit(s)) for s in SIGNS] + [F.contains(line.cast("binary"), F.lit(SIGN_BYTES))]
    other = reduce(Column.__or__, signs) & line.rlike(rf"[{WHITE}]|  ")
    return F.lower(F.trim(F.when(other, F.regexp_replace(line, rf"[ {WHITE}]+", " ")).otherwise(line)))


def once(value: Column, name: str) -> Column:
    """A value as a generator's one row: the optimizer doesn't compute it anew at each use."""
    return F.explode(F.array(value)).alias(name)


def wide(line: Column) -> Column:
    """A line in four bytes for each character, so that a stretch of it is found without a walk through the line."""
    return F.encode(line, "UTF-32")


def last_start(of: Column, chars: int) -> Column:
    """The last position, from 1, at which a shingle of a wide line begins; a shorter line is one shingle."""
    return F.greatest(F.lit(1), F.shiftright(F.octet_length(of), 2) - (chars - 1))


def shingle_at(of: Column, start: Column, chars: int) -> Column:
    return F.xxhash64(F.substring(of, 4 * start - 3, F.lit(4 * chars)))


def lines_of(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no from 0, line in normal form) of the lines that take part."""
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(text_of(text_col), "\n", -1)).alias("line_no", "raw"))
    return each.select("doc_id", "line_no", once(normal_line(F.col("raw")), "line")).where(F.length("line") >= least)


def mask(i: int) -> int:
    return (0x9E3779B97F4A7C15 * (i + 1) * (2 * i + 3)) % (1 << 64) - (1 << 63)


def hashed_rows(texts: DataFrame, chars: int, stride: int) -> DataFrame:
    """(key, last, h0, h1, ...) of (key, line) rows: the shingles of a line, so many in a row, and the last one's position."""
    own = texts.select("key", once(wide(F.col("line")), "wide"))
    own = own.select("key", "wide", once(last_start(F.col("wide"), chars), "last"))
    each = own.select("key", "wide", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(stride))).alias("start"))
    # beyond the end the last shingle is repeated
    return each.select("key", "last", *[shingle_at(F.col("wide"), F.least(F.col("start") + j, F.col("last")), chars).alias(f"h{j}") for j in range(stride)])


def signatures(texts: DataFrame, chars: int, n_hashes: int) -> DataFrame:
    """(key, s0, s1, ...) of (key, line) rows."""
    least = lambda i: F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(mask(i))) for j in range(STRIDE)])
    return hashed_rows(texts, chars, STRIDE).groupBy("key").agg(*[F.min(least(i)).alias(f"s{i}") for i in range(n_hashes)])


def shingle_set(line: Column, chars: int) -> Column:
    """The different shingles of a line, as an array. The wide line is a lambda's variable: a column's bytes would be copied for each shingle."""
    each = lambda w: F.transform(F.sequence(F.lit(1), last_start(w, chars)), lambda i: shingle_at(w, i, chars))
    return F.array_distinct(F.get(F.transform(F.array(wide(line)), each), F.lit(0)))


def bitmaps(texts: DataFrame, chars: int) -> DataFrame:
    """(key, size, b0, b1, ...) of (key, line) rows: the number of different shingles, and a bit for each of them."""
    own = texts.select("key", once(shingle_set(F.col("line"), chars), "own"))
    each = own.select("key", F.size("own").alias("size"), F.explode("own").alias("h"))
    word, bit = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(BITMAP_WORDS - 1)), F.expr("shiftleft(1L, int(h & 63L))")
    words = each.groupBy("key", "size", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("key", "size").agg(*[F.coalesce(F.max(F.when(F.col("word") == w, F.col("bits"))), F.lit(0)).alias(f"b{w}") for w in range(BITMAP_WORDS)])


def may_link(similarity: float) -> Column:
    """Whether the bitmaps of a row and of its other allow for this similarity.

    Of sets of s shingles in all, those of this similarity differ in s * (1 - similarity) / (1 + similarity) at most, and
    each bit in which their bitmaps differ stands for one that is in one set only.
    """
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"b{w}").bitwiseXOR(F.col(f"b{w}_other"))) for w in range(BITMAP_WORDS)])
    most = (F.col("size") + F.col("size_other")) * ((1 - similarity) / (1 + similarity)) + 1e-9
    return differ <= most


def own_splits(n_hashes: int) -> Column:
    """The hashes of the rows that large bands are split by."""
    return F.array(*[F.hash(*[F.col(f"s{j}") for j in range(i, min(i + SPLIT_ROWS, n_hashes))]) for i in range(0, n_hashes, SPLIT_ROWS)])


def sketched(signed: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, q0, q1, bands): four bits of each of the first 32 hashes, and the hash of each band."""
    nibble = lambda i: F.shiftleft(F.col(f"s{i}").bitwiseAND(F.lit(15)), 4 * (i % 16))
    q = [reduce(Column.bitwiseOR, [nibble(i) for i in range(lo, min(lo + 16, bands * rows))], F.lit(0).cast("long")) for lo in (0, 16)]
    own = lambda lo, n: [F.col(f"s{i}") for i in range(lo, min(lo + n, bands * rows))]
    each = [F.xxhash64(F.lit(b), *own(b * rows, rows)) for b in range(bands)]
    return signed.select("key", q[0].alias("q0"), q[1].alias("q1"), F.array(*each).alias("bands"))


def differing(a: Column, b: Column) -> Column:
    """In how many of its sixteen groups of four bits one long differs from another."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def able(most_different: int, other: str) -> Column:
    """Whether the sketches of a row and of its other allow for enough similarity."""
    return differing(F.col("q0"), F.col(f"q0_{other}")) + differing(F.col("q1"), F.col(f"q1_{other}")) <= most_different


def compared(pairs: DataFrame, texts: DataFrame, chars: int, least: float) -> DataFrame:
    """(a, b) of the pairs whose shingle sets have at least this Jaccard similarity, each pair once.

    The sets are arrays, made and intersected where the texts have met: no row is made or moved for a shingle.
    """
    side = lambda k: texts.select(F.col("key").alias(k), F.col("line").alias(f"line_{k}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    sets = both.select("a", "b", once(F.struct(*[shingle_set(F.col(f"line_{k}"), chars).alias(k) for k in "ab"]), "sets"))
    met = sets.select("a", "b", (F.size("sets.a") + F.size("sets.b")).alias("sizes"), once(F.size(F.array_intersect("sets.a", "sets.b")), "common"))
    return met.where(F.col("common") >= least * (F.col("sizes") - F.col("common"))).select("a", "b")


class Links:
    """The links found so far and the components they make."""

    def __init__(self, scratch: Scratch, texts: DataFrame, signed: DataFrame, chars: int, similarity: float, n_hashes: int):
        self.scratch, self.texts, self.signed, self.chars, self.similarity = scratch, texts, signed, chars, similarity
        self.n_hashes, self.n_sketched = n_hashes, min(SKETCHED, n_hashes)
        self.found: list[DataFrame] = []
        self.label: DataFrame | None = None

    def most_different(self, deviations: int = 3) -> int:
        """Groups of four bits in which sketches may differ: linked lines' agree in similarity + (1 - similarity) / 16 of
        them, and three deviations below that one of 700 of the least similar is lost, at four one of 30,000."""
        p = self.similarity + (1 - self.similarity) / 16
        return int(self.n_sketched * (1 - p) + deviations * (self.n_sketched * p * (1 - p)) ** 0.5)

    def named(self, rows: DataFrame) -> DataFrame:
        """rows with `of`, the component of their key."""
        if self.label is None:
            return rows.withColumn("of", F.col("key"))
        return rows.join(self.label, "key", "left").withColumn("of", F.coalesce("component", "key")).drop("component")

    def compare(self, pairs: DataFrame) -> bool:
        """Keeps the links among (key, other) rows, which may repeat; whether there are any. Their sketches or bitmaps have met."""
        own = pairs.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()
        new = self.scratch.written(compared(own, self.texts, self.chars, self.similarity), "links")
        if new.isEmpty():
            return False
        self.found.append(new)
        return True

    def relabel(self) -> None:
        """Brings the components up to the links found; comparisons between may meet lines that are linked already."""
        if self.found:
            label = connected_components(reduce(DataFrame.unionByName, self.found), "a", "b")
            self.label = label.withColumnRenamed("node", "key")

    def open_bands(self, rows: DataFrame) -> DataFrame:
        """(band, lead, q0_lead, q1_lead, lead_of, members) of the bands that hold several components; lead is the line of the
        largest one, or of all if none is larger, that most documents repeat: others are likely to be copies of it."""
        weight = F.shiftleft(F.least(F.col("n"), F.lit(1 << 30)), 32).bitwiseOR(F.xxhash64("key").bitwiseAND(F.lit((1 << 32) - 1)))
        parts = self.named(rows).withColumn("weight", weight).groupBy("band", "of").agg(
            F.count("*").alias("m"), *[F.max_by(c, "weight").alias(name) for c, name in (("key", "lead"), ("q0", "q0_lead"), ("q1", "q1_lead"))], F.max("weight").alias("weight")
        )
        best = F.max(F.struct("m", "weight", "lead", F.col("of").alias("lead_of"), "q0_lead", "q1_lead"))
        bands = parts.groupBy("band").agg(best.alias("best"), F.sum("m").alias("members"))
        return bands.where(F.col("best.m") < F.col("members")).select("band", "best.lead", "best.q0_lead", "best.q1_lead", "best.lead_of", "members")

    def star(self, rows: DataFrame) -> bool:
        """Compares the members of open bands with a leader, unless they are linked already; whether that linked any."""
        led = self.named(rows).join(self.open_bands(rows), "band").where((F.col("of") != F.col("lead_of")) & able(self.most_different(), "lead"))
        return self.compare(led.select("key", F.col("lead").alias("other")))

    def pairwise(self, rows: DataFrame) -> None:
        """Compares all members of bands of few members, unless they are linked already: (band, key, of, q0, q1) rows.

        Those whose sketch allows for a link with any other's get a bitmap.
        """
        met = rows.select(*[F.col(c).alias(f"{c}_other") for c in ("band", "of", "q0", "q1")])
        allowed = (F.col("band") == F.col("band_other")) & (F.col("of") != F.col("of_other")) & able(self.most_different(4), "other")
        rows = self.scratch.written(rows.join(met, allowed, "left_semi").select("band", "key", "of"), "near")
        if rows.isEmpty():
            return
        mapped = self.mapped(rows.select("key").distinct())
        own = rows.join(mapped, "key")
        other = own.select("band", *[F.col(c).alias(f"{c}_other") for c in ("of", *mapped.columns)])
        unlinked = (F.col("key") > F.col("key_other")) & (F.col("of") != F.col("of_other"))
        pairs = own.join(other, "band").where(unlinked & may_link(self.similarity))
        self.compare(pairs.select("key", F.col("key_other").alias("other")))

    def mapped(self, keys: DataFrame) -> DataFrame:
        """The bitmaps of keys."""
        return self.scratch.written(bitmaps(self.texts.join(keys, "key", "left_semi"), self.chars), "bitmaps")

    def by_rare_shingles(self, keys: DataFrame) -> None:
        """Compares the lines of (key, q0, q1) rows wherever they share a rare shingle and may share enough, unless they are linked already.

        Of n shingles in any order a line shares one among its first n - similarity * n + 1 with every larger linked one,
        which has it among its own so many; the smaller line of a pair needs still fewer. In the order by number of lines
        a shingle's rank bounds what is shared from the first shared one on; those of one line only come first.
        """
        own = keys.select("key").join(self.texts, "key").select("key", once(wide(F.col("line")), "wide"))
        own = own.select("key", "wide", F.explode(F.sequence(F.lit(1), last_start(F.col("wide"), self.chars))).alias("start"))
        each = self.scratch.written(own.select("key", shingle_at(F.col("wide"), F.col("start"), self.chars).alias("shingle")).distinct(), "shingles")
        often = each.groupBy("shingle").agg(F.count("*").alias("often"))
        by_key = Window.partitionBy("key")
        ranked = each.join(often, "shingle").select(
            "key", "shingle", "often", F.row_number().over(by_key.orderBy("often", "shingle")).alias("rank"), F.count("*").over(by_key).alias("n")
        )
        needed = lambda part: F.col("n") - F.ceil(F.col("n") * part - 1e-9) + 1
        indexed = F.col("rank") <= needed(2 * self.similarity / (1 + self.similarity))
        kept = ranked.where((F.col("rank") <= needed(self.similarity)) & (F.col("often") > 1))
        kept = kept.select("shingle", "key", "n", "rank", indexed.alias("indexed")).join(keys, "key")
        left = self.named(self.scratch.written(kept, "rare"))
        other = left.where("indexed").select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("key", "n", "rank", "of", "q0", "q1")])
        order = (F.col("n") > F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("key") > F.col("key_b")))
        most = 1 + F.least(F.col("n") - F.col("rank"), F.col("n_b") - F.col("rank_b"))
        enough = (1 + self.similarity) * most >= self.similarity * (F.col("n") + F.col("n_b")) - 1e-9
        pairs = left.join(other, "shingle").where(order & enough & (F.col("of") != F.col("of_b")) & able(self.most_different(), "b"))
        pairs = self.scratch.written(pairs.select("key", F.col("key_b").alias("key_other")).distinct(), "pairs")
        mapped = self.mapped(pairs.select("key").unionByName(pairs.select(F.col("key_other").alias("key"))).distinct())
        other = mapped.select(*[F.col(c).alias(f"{c}_other") for c in mapped.columns])
        self.compare(pairs.join(mapped, "key").join(other, "key_other").where(may_link(self.similarity)).select("key", F.col("key_other").alias("other")))


def compare_groups(rows: DataFrame, links: Links) -> DataFrame:
    """Links the members of the groups `band` of (band, key, n, q0, q1, ...) rows; the rows of those too large to be compared in full."""
    if links.star(rows):
        links.relabel()
    left = links.named(rows).join(links.open_bands(rows).select("band", "members"), "band")
    left = links.scratch.written(left, "left")
    links.pairwise(left.where(F.col("members") <= FEW_MEMBERS))
    return left.where(F.col("members") > FEW_MEMBERS).drop("of", "members")


def find_links(rows: DataFrame, links: Links, n_rows: int) -> DataFrame | None:
    """(key, component) of all links among the members of a band, None if there are none: (band, number, key, n, q0, q1) rows."""
    large = compare_groups(rows, links)
    if not large.isEmpty():
        compare_large(large, links, n_rows)
    links.relabel()
    return links.label


def compare_large(large: DataFrame, links: Links, n_rows: int) -> None:
    """Links the members of (band, number, key, n, q0, q1) rows of large bands, which are split by rows that aren't the band's own."""
    low, high = F.col("i") * SPLIT_ROWS, F.col("i") * SPLIT_ROWS + SPLIT_ROWS - 1
    other = (high < F.col("number") * n_rows) | (low >= (F.col("number") + 1) * n_rows)
    own = ["key", "n", "q0", "q1"]
    texts = links.texts.join(large.select("key").distinct(), "key", "left_semi")
    splits = signatures(texts, links.chars, links.n_hashes).select("key", own_splits(links.n_hashes).alias("splits"))
    split = large.join(splits, "key").select("band", "number", *own, F.posexplode("splits").alias("i", "split")).where(other)
    split = links.scratch.written(split.select(F.xxhash64("band", "i", "split").alias("band"), *own), "split")
    left = compare_groups(split, links)
    keys = links.scratch.written(left.select("key", "q0", "q1").distinct(), "large")
    if not keys.isEmpty():
        links.by_rare_shingles(keys)


def line_components(
    docs: DataFrame,
    chars: int = 5,
    similarity: float = 0.8,
    bands: int = 9,
    rows: int = 4,
    min_chars: int = 16,
    exact_from: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no, kept) of every line that has an equal or similar one.

    A component's kept line is its first by doc_id and line number. Lines shorter than min_chars in normal form (lower
    case, single blanks) have equal ones only, those shorter than exact_from none, nor have blank lines, null and empty
    texts; lines of any length are compared whole. Rows of one doc_id are one document: repeated rows keep the same
    lines. Extra columns are ignored, an empty table gives no rows. Lines of similarity s share a band with probability
    1 - (1 - s**rows)**bands, 0.991 at 0.8, and are then compared, but for pairs whose sketches differ by three deviations
    more than such similar lines' do, however many lines share it: large bands are split in ten ways, of which similar
    lines share one with probability 0.999. Keys have 64 bits.
    """
    spark = docs.sparkSession
    n_buckets = min(2 * task_count(spark), 20_000)
    lines = lines_of(docs, max(1, exact_from), id_col, text_col).withColumn("key", F.xxhash64("line"))
    place = F.struct("doc_id", "line_no")
    with Scratch(spark, tidy=True) as scratch:
        held = lines.groupBy("key").agg(F.first("line").alias("line"), F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
        held = scratch.bucketed(held, "lines", "key", n_buckets)
        texts = held.where(F.length("line") >= min_chars).select("key", "line")
        signed = sketched(signatures(texts, chars, bands * rows), bands, rows).join(held.select("key", "n"), "key")
        signed = scratch.written(signed, "signed")
        # keys are distinct and bands of one key differ; rows of shared bands get their columns once they are known
        each = signed.select("key", F.posexplode("bands").alias("number", "band"))
        wanted = scratch.written(each.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band"), "wanted")
        shared = scratch.written(each.join(wanted, "band", "left_semi"), "shared")
        banded = scratch.written(shared.join(signed.select("key", "n", "q0", "q1"), "key"), "banded")
        label = find_links(banded, Links(scratch, texts, signed, chars, similarity, bands * rows), rows)

        # a component's lines are reckoned from one row for each key, whatever number of lines have it
        own = held.select("key", "first", "last")
        own = own.withColumn("component", F.col("key")) if label is None else own.join(label, "key", "left").withColumn("component", F.coalesce("component", "key"))
        ends = own.groupBy("component").agg(F.min("first").alias("kept_place"), F.max("last").alias("last")).where("kept_place <> last")
        kept = scratch.written(own.select("key", "component").join(ends, "component").select("key", "kept_place"), "kept", keep=True)
    found = lines.select("key", "doc_id", "line_no").join(kept, "key").select("doc_id", "line_no", "kept_place").distinct()
    return found.select(
        "doc_id", "line_no", F.col("kept_place.doc_id").alias("kept_doc_id"), F.col("kept_place.line_no").alias("kept_line_no"),
        (F.col("kept_place") == place).alias("kept"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact_from: int = 16, **how: object) -> DataFrame:
    """docs with every line gone that isn't the kept one of its component; rows that lose all their lines go as well.

    Equal lines of fewer than exact_from characters all stay: such short ones repeat in any text.
    Rows without any line to lose are as they were, null and empty texts included.
    """
    gone = line_components(docs, id_col=id_col, text_col=text_col, exact_from=exact_from, **how).where(~F.col("kept"))
    by_doc = gone.groupBy(F.col("doc_id").alias("_gone_id")).agg(F.collect_set("line_no").alias("_gone"))
    joined = docs.join(by_doc, docs[id_col].cast("long") == F.col("_gone_id"), "left")
    split = joined.select("*", once(F.split(F.when(F.col("_gone").isNotNull(), F.col(text_col)), "\n", -1), "_lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    wide = split.withColumn("_kept", F.when(F.col("_gone").isNotNull(), F.transform(places, lambda i: F.get("_lines", i))))
    rest = F.when(F.col("_kept").isNull(), F.col(text_col)).otherwise(F.array_join("_kept", "\n"))
    full = F.col("_kept").isNull() | F.exists("_kept", lambda x: F.trim(x) != "")
    return wide.where(full).withColumn(text_col, rest).select(*docs.columns)
