"""Packing by cutting stock: a linear program over patterns of document lengths, solved by column generation.

Full stretches of `size` tokens are cut off long documents. What remains of each document falls into a length class, and
the histogram of the classes, bounded by `size`, is all that the driver sees. Patterns are combinations of classes that
fill a sequence; knapsack dynamic programming prices them. Rounded down, the patterns say how many sequences of each kind
there are; documents, ranked within their length, take the places by arithmetic. Documents that no pattern takes are
laid end to end, by arithmetic again, and cut at sequence bounds; their tail is cut at powers of two, which need no
padding.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, in_arrow, kept, task_count, text_of, written

#: Longer chunks and words aren't remembered.
LONGEST = 48
#: Bytes of memory of the memo of words, which cost most to make.
WORD_BYTES = 64 << 20
#: Documents placed at a time, and chunks whose ids are laid out at a time.
SLICE, CHUNKS_AT_ONCE = 256, 1 << 18
#: Punctuation that may stand around a word.
MARKS = ".,;:!?|*$%&#()[]\"/"
NOT_LATIN = re.compile("[^\0-\u024f]")
IDS_SCHEMA = "uid long, doc_id long, n long, ids binary"
PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> list[str]:
    """How byte-level tokenizers write bytes: printable Latin ones as themselves, the others from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    return [moved.get(b, chr(b)) for b in range(256)]


class WordEncoder:
    """Ids by a tokenizers file as little-endian bytes.

    A tokenizer that drops white space encodes what stands between blanks on its own, so each different chunk of a batch is
    encoded once. Where it also parts letters from punctuation and lowers case, a chunk is its word and the marks
    around it, and words are remembered apart from chunks; a word of letters goes straight to the model. That holds only
    for words whose lower case is letters, one for each, in composed form: others leave marks that belong to what follows.
    Probes of the library decide which of this holds for the file; without it whole texts are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.kind = "<u2" if self.model.get_vocab_size() <= 0x10000 else "<u4"
        self.marks, self.words = Memo(self.whole, longest=LONGEST), Memo(self.word, longest=LONGEST, most=WORD_BYTES)
        self.letters = byte_letters()
        probe = "The  quick\nbrown fox's 12 dogs.\n\n(Été) "
        self.apart = self.whole(probe) == b"".join(self.whole(x) for x in probe.replace("\n", " ").split(" "))
        whole = [self.whole(m + w + e) == self.whole(m) + self.whole(w) + self.whole(e) for w in ("Word", "çéñß", "12") for m in ("", *MARKS) for e in ("", *MARKS, ".)")]
        cased = [self.whole(w) == self.whole(w.lower()) == self.word(w.lower()) for w in ("Word", "THE", "ÉTÉ", "Straße", "ñandú", "unforeseeably")]
        self.parted = self.apart and all(whole) and all(cased)

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def word(self, letters: str) -> bytes:
        """The ids of a word of lower-case letters in composed form."""
        own = letters if letters.isascii() else "".join([self.letters[b] for b in letters.encode()])
        ids = [x.id for x in self.model.model.tokenize(own)]
        return struct.pack(f"<{len(ids)}{'H' if self.kind == '<u2' else 'I'}", *ids)

    def chunk(self, chunk: str) -> bytes:
        left = chunk.lstrip(MARKS)
        core = left.rstrip(MARKS)
        if not self.parted or not core.isalpha() or len(core) > LONGEST or NOT_LATIN.search(core):
            return self.whole(chunk)
        low = core.lower()
        if not low.isascii() and (len(low) != len(core) or not low.isalpha() or not unicodedata.is_normalized("NFC", core)):
            return self.whole(chunk)
        before, after = chunk[: len(chunk) - len(left)], left[len(core) :]
        return (self.marks[before] if before else b"") + self.words[low] + (self.marks[after] if after else b"")

    def each_chunk(self, chunks: pa.Array) -> list[bytes]:
        """chunk() of each of many: those whose words are ASCII letters share what is looked up."""
        left = pc.utf8_ltrim(chunks, MARKS)
        core = pc.utf8_rtrim(left, MARKS)
        plain = pc.and_(pc.ascii_is_alpha(core), pc.less_equal(pc.binary_length(core), LONGEST if self.parted else 0))
        out = np.empty(len(chunks), dtype=object)
        held = np.asarray(plain)
        words = pc.ascii_lower(core.filter(plain)).dictionary_encode()
        out[held] = np.array([*map(self.words.__getitem__, words.dictionary.to_pylist()), None], dtype=object)[np.asarray(words.indices)]
        marked = pc.and_(plain, pc.less(pc.binary_length(core), pc.binary_length(chunks)))
        rows = (x.filter(marked).to_pylist() for x in (chunks, left, core))
        marks, at = self.marks, np.flatnonzero(np.asarray(marked))
        for i, c, x, w in zip(at.tolist(), *rows, strict=True):
            before, after = c[: len(c) - len(x)], x[len(w) :]
            out[i] = (marks[before] if before else b"") + out[i] + (marks[after] if after else b"")
        out[~held] = np.array([*map(self.chunk, chunks.filter(pc.invert(plain)).to_pylist()), None], dtype=object)[:-1]
        return out.tolist()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.chunk, text.replace("\n", " ").split(" "))) if self.apart else self.whole(text)

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, pa.Array]:
        """(how many ids, the ids as bytes) of each text of a batch, end_id after them."""
        kind, end = np.dtype(self.kind), np.array([end_id], dtype=self.kind)
        if not self.apart:
            each = [self.whole(t) + end.tobytes() for t in texts.to_pylist()]
            return np.array([len(x) // kind.itemsize for x in each], dtype=np.int64), pa.array(each, pa.binary())
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        ends = np.asarray(parts.offsets)[1:] - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        known = self.each_chunk(coded.dictionary)
        # the end id is one more chunk, after the last of each text
        which = np.insert(np.asarray(coded.indices), ends, len(known))
        size = np.array([*map(len, known), kind.itemsize]) // kind.itemsize
        ids, first = np.frombuffer(b"".join([*known, end.tobytes()]), dtype=kind), np.cumsum(size) - size
        at = np.concatenate([[0], np.cumsum(size[which])])
        out = np.empty(at[-1], dtype=kind)
        for lo in range(0, len(which), CHUNKS_AT_ONCE):
            own = which[lo : lo + CHUNKS_AT_ONCE]
            begin, n = at[lo], size[own]
            out[begin : at[lo + len(own)]] = ids[np.repeat(first[own] - at[lo : lo + len(own)], n) + np.arange(begin, at[lo + len(own)])]
        bounds = at[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]
        held = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds * kind.itemsize), pa.py_buffer(out)])
        return np.diff(bounds), held.cast(pa.binary())


def encoder(path: str) -> WordEncoder:
    return kept(("packing", path), partial(WordEncoder, path))


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """IDS_SCHEMA rows: each document's ids with end_id after them, of null and empty texts end_id alone; uid tells
    repeated rows apart. Extra columns are left out, an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for b in batches:
            n, ids = own.encode_all(b.column("text"), end_id)
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), pa.array(n, pa.int64()), ids], ["uid", "doc_id", "n", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return in_arrow(rows, "packing", run, IDS_SCHEMA)


def best_pattern(units: np.ndarray, value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Knapsack: the most valuable multiset of classes whose units add up to room exactly, -inf if there is none."""
    best, took = np.full(room + 1, -np.inf), np.full(room + 1, -1)
    best[0] = 0.0
    fits = np.searchsorted(units, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        if fits[c]:
            gain = best[c - units[: fits[c]]] + value[: fits[c]]
            took[c] = k = int(gain.argmax())
            best[c] = gain[k]
    pattern, c = np.zeros(len(units)), room
    while c and np.isfinite(best[room]):
        pattern[took[c]] += 1
        c -= units[took[c]]
    return float(best[room]), pattern


def column_generation(units: np.ndarray, counts: np.ndarray, room: int, cut_cost: float = 0.05, rounds: int = 2500) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, how many of each, whole numbers): min sequences + cost of the documents left over, by the simplex method.

    A document left over costs its share of a sequence and cut_cost. Stopping after `rounds` columns leaves a valid,
    less good plan. Bounded work: at most `room` classes.
    """
    m = len(units)
    inverse, amount = np.eye(m), counts.astype(float)
    cost, basis = units / room + cut_cost, [np.zeros(0)] * m
    dual = cost.copy()
    basis_cost = cost.copy()
    for _ in range(rounds):
        value, pattern = best_pattern(units, dual, room)
        if value < 1 + 1e-7:
            break
        step = inverse @ pattern
        able = step > 1e-9
        if not able.any():
            break
        ratio = np.where(able, amount / np.where(able, step, 1), np.inf)
        leave = int(ratio.argmin())
        theta = ratio[leave]
        amount = np.maximum(amount - theta * step, 0)
        amount[leave] = theta
        inverse[leave] /= step[leave]
        step[leave] = 0
        inverse -= np.outer(step, inverse[leave])
        basis[leave], basis_cost[leave] = pattern, 1.0
        dual = basis_cost @ inverse
    chosen = [(p, x) for p, x in zip(basis, amount, strict=True) if len(p)]
    if not chosen:
        return np.zeros((0, m), int), np.zeros(0, int)
    patterns, x = np.array([p for p, _ in chosen]).astype(int), np.array([x for _, x in chosen])
    whole = np.floor(x + 1e-7).astype(int)
    rest = counts - whole @ patterns
    while (rest < 0).any():  # only by rounding errors
        whole[np.argmax((patterns * (rest < 0)).sum(1) * (whole > 0))] -= 1
        rest = counts - whole @ patterns
    for p in np.argsort(whole - x, kind="stable"):
        held = patterns[p] > 0
        more = int((rest[held] // patterns[p][held]).min())
        whole[p] += more
        rest = rest - more * patterns[p]
    return patterns[whole > 0], whole[whole > 0]


def tail_bounds(tokens: int, size: int) -> list[int]:
    """Where the stream of tokens left over is cut after its last full sequence: at powers of two, largest first."""
    at, out = tokens - tokens % size, []
    for bit in reversed(range(size.bit_length())):
        if (tokens % size) >> bit & 1:
            at += 1 << bit
            out.append(at)
    return out


def pack(
    docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, step: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """PIECES_SCHEMA rows: which stretch of which document lies where in which sequence of at most size tokens.

    Every id of every document, end_id last, lies in exactly one piece; null and empty texts have end_id alone. Offsets
    in a sequence are gapless from 0. Repeated rows are packed once each; documents of equal length are ranked by a row
    number, extra columns are ignored, and an empty table gives no rows. step is the width of a length class: a sequence
    of k whole documents is padded by less than k * step. A length that a third of all documents share is ranked in
    salted groups, each in its own task.
    """
    if size < 1 or size & (size - 1) or size % step:
        raise ValueError("size must be a power of two and a multiple of step")
    spark = docs.sparkSession
    held = written(tokenized(docs, tokenizer_path, end_id, id_col, text_col), "ids")
    kind = WordEncoder(tokenizer_path).kind
    n_salts = task_count(spark)
    rest = (F.col("n") % size).alias("rest")
    lengths = held.select("uid", "n", rest, F.pmod(F.xxhash64("uid"), F.lit(n_salts)).alias("salt"))

    by_salt = Window.partitionBy("salt").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    full = F.floor(F.col("n") / size)
    salts = lengths.groupBy("salt").agg(F.sum(full).alias("full")).orderBy("salt").collect()
    full_at = np.concatenate([[0], np.cumsum([r["full"] for r in salts])]).astype(int)
    full_base = spark.createDataFrame([(int(r["salt"]), int(x)) for r, x in zip(salts, full_at, strict=False)], "salt long, full_base long")

    cells = lengths.groupBy("rest", "salt").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cell_base = cells.select("rest", "salt", before.alias("cell_base"))
    histogram = {int(r["rest"]): int(r["c"]) for r in cells.groupBy("rest").agg(F.sum("c").alias("c")).where("rest > 0").collect()}

    # classes in units of step, documents of a class ordered by length
    each = np.array(sorted(histogram), dtype=int)
    many = np.array([histogram[x] for x in each], dtype=int)
    unit = -(-each // step)
    units, where = np.unique(unit, return_inverse=True)
    counts = np.bincount(where, many, len(units)).astype(int) if len(each) else np.zeros(0, int)
    patterns, whole = column_generation(units, counts, size // step) if len(units) else (np.zeros((0, 0), int), np.zeros(0, int))
    sequence_base = int(full_at[-1])
    places, taken = [], np.zeros(len(units), int)
    for p, n in zip(patterns, whole, strict=True):
        for j in np.flatnonzero(p):
            places.append((int(units[j]), int(taken[j]), int(taken[j] + p[j] * n), int(p[j]), sequence_base))
            taken[j] += p[j] * n
        sequence_base += int(n)
    # of each length: how many documents of its class are shorter, from which rank on they are left over, and where that stretch begins
    per_length, stream = [], 0
    if len(each):
        shorter = np.cumsum(many) - many
        first = np.r_[True, where[1:] != where[:-1]]
        shorter = shorter - np.maximum.accumulate(np.where(first, shorter, 0))
        for x, c, j, s in zip(each, many, where, shorter, strict=True):
            kept = int(np.clip(taken[j] - s, 0, c))
            per_length.append((int(x), int(units[j]), int(s), kept, stream))
            stream += int(x) * (int(c) - kept)
    bounds = tail_bounds(stream, size)

    # at most `size` lengths and, for each of at most size / step patterns, at most size / step classes: bounded, so broadcast
    length_table = F.broadcast(spark.createDataFrame(per_length, "rest long, unit long, shorter long, kept long, stream_base long"))
    place_table = F.broadcast(spark.createDataFrame(places, "p_unit long, lo long, hi long, each long, sequence_base long"))
    ranked = (
        lengths.withColumn("k", F.row_number().over(Window.partitionBy("rest", "salt").orderBy("uid")) - 1)
        .withColumn("full_before", F.coalesce(F.sum(full).over(by_salt), F.lit(0)))
        .join(cell_base, ["rest", "salt"])
        .join(F.broadcast(full_base), "salt")
        .withColumn("k", F.col("k") + F.col("cell_base"))
        .join(length_table, "rest", "left")
        .withColumn("class_rank", F.when(F.col("k") < F.col("kept"), F.col("shorter") + F.col("k")))
        .join(place_table, (F.col("unit") == F.col("p_unit")) & (F.col("class_rank") >= F.col("lo")) & (F.col("class_rank") < F.col("hi")), "left")
        .select(
            "uid", "rest",
            (F.col("full_base") + F.col("full_before")).alias("full_id"),
            (F.col("sequence_base") + F.floor((F.col("class_rank") - F.col("lo")) / F.col("each"))).alias("sequence"),
            (F.col("stream_base") + (F.col("k") - F.col("kept")) * F.col("rest")).alias("stream_at"),
        )
    )
    taken_places = ranked.where(F.col("sequence").isNotNull())
    in_sequence = Window.partitionBy("sequence").orderBy(F.desc("rest"), "uid").rowsBetween(Window.unboundedPreceding, -1)
    taken_places = taken_places.withColumn("at", F.coalesce(F.sum("rest").over(in_sequence), F.lit(0)))
    placed = taken_places.unionByName(ranked.where(F.col("sequence").isNull()).withColumn("at", F.lit(None).cast("long")))

    stream_base, tail = sequence_base, stream - stream % size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part.slice(lo, SLICE) for part in batches for lo in range(0, part.num_rows, SLICE)):
            out: list[tuple] = []
            for r in b.to_pylist():
                ids, n = np.frombuffer(r["ids"], dtype=kind).astype("<u4"), r["n"]
                pieces = [(j * size, size, r["full_id"] + j, 0) for j in range(n // size)]
                start = n - n % size
                if r["sequence"] is not None:
                    pieces.append((start, n - start, r["sequence"], r["at"]))
                else:
                    at = r["stream_at"]
                    while start < n:
                        if at < tail:
                            end, sequence, begin = at - at % size + size, stream_base + at // size, at - at % size
                        else:
                            i = int(np.searchsorted(bounds, at, side="right"))
                            end, sequence, begin = bounds[i], stream_base + tail // size + i, bounds[i - 1] if i else tail
                        length = min(end - at, n - start)
                        pieces.append((start, length, sequence, at - begin))
                        start, at = start + length, at + length
                out += [(r["doc_id"], s, k, zlib.crc32(ids[s : s + k].tobytes()), n, q, o) for s, k, q, o in pieces]
            if out:
                columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    joined = held.join(placed, "uid").select("doc_id", "n", "ids", "full_id", "sequence", "at", "stream_at")
    # another name than the encoder's: workers drop it and its memos before they take documents and ids
    return in_arrow(joined, "placing", run, PIECES_SCHEMA)
