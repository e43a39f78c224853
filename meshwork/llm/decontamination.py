"""Benchmark decontamination by the CGK embedding and bit-sampling LSH.

The embedding walks over a string of words: at step j it puts out the current word's letter and moves on if a random
function of j and that letter says so. Strings at a small edit distance fall into step again after an edit, so their walks
have a small Hamming distance. Each repetition walks with other functions and samples a few steps; windows and items
that agree in all samples are candidates. The bound is one of characters, so letters are, too: half of the repetitions
walk over the words' first characters, the others over their last, and a mistyped word mostly keeps one of the two.

Only windows that share some runs of beginnings, or of ends, with the benchmark are walked at all. Candidates are
verified by the exact edit distance of stretch and item.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Scratch, in_arrow, kept, text_of

#: Scripts that are written without blanks: each character is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
ASCII_WORD, WORD = re.compile(r"\w+"), re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
#: Items of fewer words are searched for as they are, without edits.
LEAST_WORDS = 5
#: A window is walked if it holds one of the runs of RUN words' beginnings, or of their ends, of the items of its size; windows
#: of fewer than SMALL words may hold a run of two whole words instead. Of strings with half their words mistyped, or a
#: quarter replaced, three in ten such runs are left.
RUN, SMALL = 4, 8
#: The least number of steps between a walk's samples.
GAP = 3
#: Windows of fewer words get more repetitions.
SMALL_WINDOW = 20
#: The least number of characters of a beginning and an end.
AFFIX = 3
#: Of an item's pairs of neighbouring beginnings, or of ends, a place must show this share for texts to be compared there.
#: Where each word is mistyped once, a quarter is left; walks find such items less often than this.
PAIR_SHARE = 0.2
#: Places of one item that lie within this share of its length of one another are verified as one.
MERGED = 1 / 16
#: By how many parts of its length a stretch may be shorter or longer than the item.
STRETCHES = (0, -1 / 16, 1 / 16, -1 / 8, 1 / 8)
#: By how many parts of the item's length, a word at least, it may begin before or after where a walk met it.
SHIFTS = (0, -1 / 32, 1 / 32, -1 / 16, 1 / 16)
#: Texts walked at a time.
SLICE = 256
#: Windows walked at a time.
AT_A_TIME = 4096
FOUND = "doc_id long, item_id long, start_word long, edits int, similarity double"
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_keys(word: str) -> bytes:
    """The hashes of a word, and of its first and last half, which are AFFIX characters at least."""
    n = max(AFFIX, (len(word) + 1) // 2)
    return xxhash.xxh64_digest(word) + xxhash.xxh64_digest(word[:n]) + xxhash.xxh64_digest(word[-n:])


#: Bytes of the memo of word_keys: enough for the words that a task meets again.
WORD_BYTES = 96 << 20


def word_memo() -> Memo:
    return kept("decontamination", partial(Memo, word_keys, most=WORD_BYTES))


def keys_of(words: list[str], known: Memo) -> np.ndarray:
    """(words, 3): word_keys of each."""
    return np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint64).reshape(-1, 3)


def words_of(text: str) -> list[str]:
    return (ASCII_WORD if text.isascii() else WORD).findall(text.lower())


def joined(key: np.ndarray, own: np.ndarray) -> np.ndarray:
    key = (key ^ own) * MIX
    return key ^ (key >> np.uint64(31))


def window_size(n_words: int) -> tuple[int, int]:
    """(words of a window, stride) for an item: sizes go up by halves from 4, and windows lie so close that one of them
    lies in the item wherever it begins."""
    size = 4
    while (bigger := size + max(1, size // 2)) + bigger // 4 - 1 <= n_words:
        size = bigger
    return size, max(1, size // 4)


class Pattern:
    """An item's text, compared with texts by bits: a column of the table of edit distances is two whole numbers."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self.places: dict[str, int] = {}
        for i, c in enumerate(text):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def distances(self, text: str) -> list[int]:
        """The edit distances of the item to each beginning of text, the empty one first (Myers' bit-parallel recurrence)."""
        mask, high = (1 << self.n) - 1, 1 << (self.n - 1)
        up, down, score, out = mask, 0, self.n, [self.n]
        for c in text:
            same = self.places.get(c, 0)
            across = ((((same & up) + up) ^ up) | same) & mask
            more, less = down | (~(across | up) & mask), up & across
            score += (more & high > 0) - (less & high > 0)
            more, less = (more << 1 | 1) & mask, (less << 1) & mask
            up, down = less | (~(same | down | more) & mask), more & (same | down)
            out.append(score)
        return out


def repetitions(size: int, n: int) -> int:
    """Half as many again for small windows: their items hold few of them, so fewer chances to be met."""
    return n + n // 2 if size < SMALL_WINDOW else n


class Walks:
    """All repetitions' walks over windows of `size` words, each with its samples, and the items' keys under them."""

    def __init__(self, size: int, stride: int, n_repetitions: int, n_samples: int):
        self.size, self.stride, self.n = size, stride, n_repetitions
        rng = np.random.default_rng([size, 7])
        # a walk is twice as slow as the string; samples lie anywhere on it
        length = max(2 * n_samples, int(1.6 * size))
        n = min(n_samples, size)
        # two steps in a row mostly put out one word: samples are GAP apart, or strings meet by chance in a word or two
        gap = min(GAP, max(1, length // n))
        samples = np.array([np.sort(rng.choice(length - (n - 1) * (gap - 1), n, replace=False)) + np.arange(n) * (gap - 1) for _ in range(n_repetitions)])
        #: the repetitions that sample each step
        self.sampled = [np.flatnonzero((samples == j).any(1)) for j in range(length)]
        self.steps = rng.integers(0, 1 << 63, (length, n_repetitions, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.keys, self.owner = np.zeros(0, np.uint64), np.zeros((0, 2), np.int32)

    def walk(self, keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The keys of the walks that begin at starts, a row for each repetition, over word_keys, which end in more padding than a
        walk is long. The repetition is part of the key."""
        at, part = np.broadcast_to(starts, (self.n, len(starts))).copy(), 1 + np.arange(self.n)[:, None] % 2
        key = np.broadcast_to((np.arange(self.n, dtype=np.uint64) * MIX)[:, None], at.shape).copy()
        for steps, sampled in zip(self.steps, self.sampled, strict=True):
            own = keys[at, part]
            if len(sampled):
                key[sampled] = joined(key[sampled], own[sampled])
            at += ((own * steps) >> np.uint64(63)).astype(np.int64)
        return key

    def index(self, words: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> None:
        """Keys of every window of the items that a document's window may meet: those at offsets below the stride."""
        keys = self.walk(words, starts).ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order % len(starts)]

    def meetings(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, owner) of the windows whose key an item has too, an entry for each such item."""
        key = self.walk(words, starts).ravel()
        lo = np.searchsorted(self.keys, key, "left")
        hit = np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == key)
        hi, lo = np.searchsorted(self.keys, key[hit], "right"), lo[hit]
        which = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in zip(lo, hi, strict=True))])
        return np.repeat(starts[hit % len(starts)], hi - lo), self.owner[which]


class RunSet:
    """Hashes of runs of n words: a bitmap of 256 bits for each and more, and the hashes themselves for what it lets through."""

    def __init__(self, runs: np.ndarray):
        self.runs = np.unique(runs)
        self.shift = np.uint64(64 - max(16, min(32, (256 * len(runs)).bit_length())))
        at = runs >> self.shift
        self.held = np.zeros(1 << (61 - int(self.shift)), dtype=np.uint8)
        np.bitwise_or.at(self.held, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def sums(self, runs: np.ndarray) -> np.ndarray:
        """How many of the runs before each place are held."""
        at = runs >> self.shift
        bit = (self.held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        hit = np.flatnonzero(bit)
        found = np.minimum(np.searchsorted(self.runs, runs[hit]), len(self.runs) - 1)
        out = np.zeros(len(runs) + 1, np.int64)
        out[1:][hit[self.runs[found] == runs[hit]]] = 1
        return np.cumsum(out)


def index_bytes(n_words: int, n_repetitions: int) -> int:
    """Bytes of an item in the index: a key and an owner for each repetition and offset, and the bitmaps of its runs."""
    size, stride = window_size(n_words)
    return stride * repetitions(size, n_repetitions) * 16 + n_words * (3 * 72 + 2 * 100) + 256


class Bench:
    """What a block of the benchmark is searched by: its word runs, its walks and, for short items, its word sequences."""

    def __init__(self, items: list[tuple[int, list[str]]], n_repetitions: int, n_samples: int):
        known = Memo(word_keys)
        self.sizes = [len(words) for _, words in items]
        self.ids = [item for item, _ in items]
        self.texts = [" ".join(words) for _, words in items]
        own = [(number, words, keys_of(words, known)) for number, (_, words) in enumerate(items)]
        long = [x for x in own if len(x[1]) >= LEAST_WORDS]
        by_size: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for number, _, keys in long:
            by_size.setdefault(window_size(len(keys)), []).append((number, keys))
        runs = lambda held, column, n: RunSet(np.concatenate([self.sequences(keys[:, column], n) for _, keys in held]))
        #: each size's walks, and runs of whole words, beginnings and ends of its items
        self.walks: list[tuple[Walks, list[tuple[RunSet, int, int]]]] = []
        for (size, stride), held in sorted(by_size.items()):
            pad = np.zeros((2 * size + 8, 3), np.uint64)
            begins = np.cumsum([0, *(len(keys) + len(pad) for _, keys in held)])[:-1]
            owner = np.array([(number, o) for number, _ in held for o in range(stride)], dtype=np.int32)
            walks = Walks(size, stride, repetitions(size, n_repetitions), n_samples)
            walks.index(np.concatenate([x for _, keys in held for x in (keys, pad)]), (begins[:, None] + np.arange(stride)).ravel(), owner)
            kinds = [(1, RUN), (2, RUN)] if size >= SMALL else [(1, RUN), (2, RUN), (0, 2)]
            self.walks.append((walks, [(runs(held, column, n), column, n) for column, n in kinds]))
        self.pair_sets = [tuple(frozenset(self.sequences(keys[:, c], 2).tolist()) for c in (1, 2)) for _, _, keys in own]
        self.short: dict[int, dict[int, list[int]]] = {}
        for number, words, keys in own:
            if 0 < len(words) < LEAST_WORDS:
                self.short.setdefault(len(words), {}).setdefault(int(self.sequences(keys[:, 0], len(words))[0]), []).append(number)
        self.padding = 2 * max((w.size for w, _ in self.walks), default=LEAST_WORDS) + 8

    @staticmethod
    def sequences(words: np.ndarray, n: int) -> np.ndarray:
        key = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for j in range(n):
            key = joined(key, words[j : len(words) - n + 1 + j])
        return key

    def met(self, texts: list[list[str]], known: Memo) -> set[tuple[int, int, int]]:
        """(text, item, first word) of what may hold an item."""
        pad = np.zeros((self.padding, 3), np.uint64)
        keys = np.concatenate([x for words in texts for x in (keys_of(words, known), pad)])
        lengths = np.array([len(w) for w in texts], dtype=np.int64)
        begins = np.cumsum(lengths + self.padding) - lengths - self.padding
        found: dict[tuple[int, int], list[int]] = {}
        made = {(column, n): self.sequences(keys[:, column], n) for _, sets in self.walks for _, column, n in sets}
        for w, sets in self.walks:
            starts = np.concatenate([np.zeros(0, np.int64), *(np.arange(b, b + k, w.stride) for b, k in zip(begins, lengths, strict=True))])
            holds = np.zeros(len(starts), bool)
            for held, column, n in sets:
                sums = held.sums(made[column, n])
                holds |= sums[np.minimum(starts + max(0, w.size - n + 1), len(sums) - 1)] > sums[starts]
            starts = starts[holds]
            for lo in range(0, len(starts), AT_A_TIME):
                at, owner = w.meetings(keys, starts[lo : lo + AT_A_TIME])
                d = np.searchsorted(begins, at, "right") - 1
                for text, item, start in zip(d.tolist(), owner[:, 0].tolist(), np.maximum(at - begins[d] - owner[:, 1], 0).tolist(), strict=True):
                    found.setdefault((text, item), []).append(start)
        pairs = [self.sequences(keys[:, c], 2) for c in (1, 2)] if found else []
        out = set()
        for (d, item), places in found.items():
            n = self.sizes[item]
            for start in self.merged(places, n):
                lo, hi = begins[d] + max(0, start - n // 8), begins[d] + min(int(lengths[d]), start + n + n // 8) - 1
                if any(len(own.intersection(p[lo:hi].tolist())) >= PAIR_SHARE * len(own) for own, p in zip(self.pair_sets[item], pairs, strict=True)):
                    out.add((d, item, start))
        for n, own in self.short.items():
            key = self.sequences(keys[:, 0], n)
            for at in np.flatnonzero(np.isin(key, np.fromiter(own, np.uint64, len(own)))).tolist():
                d = int(np.searchsorted(begins, at, "right")) - 1
                if at + n <= begins[d] + lengths[d]:
                    out.update((d, number, at - int(begins[d])) for number in own[int(key[at])])
        return out

    @staticmethod
    def merged(places: list[int], n_words: int) -> list[int]:
        """The places that most meetings name first; of those close to one that is taken none."""
        near, taken = int(MERGED * n_words), []
        for place, _ in sorted(Counter(places).items(), key=lambda x: (-x[1], x[0])):
            if all(abs(place - t) > near for t in taken):
                taken.append(place)
        return taken

    def best_place(self, item: int, pattern: Pattern, start: int, words: list[str], most_edits: float) -> tuple[int, int, float] | None:
        """(edits, first word, similarity) of the stretch nearest to an item that a text may hold from start on, if it lies within the
        bound. Stretches that begin at one word are beginnings of the longest of them: one table has all their distances."""
        n, bound = self.sizes[item], int(pattern.n * most_edits + 1e-9)
        shifts, lengths = (SHIFTS, STRETCHES) if n >= LEAST_WORDS else ((0,), (0,))
        begins = list(dict.fromkeys(max(0, start + (int(np.copysign(max(1, round(abs(p) * n)), p)) if p else 0)) for p in shifts))
        best = None
        for k, b in enumerate(begins):
            own = words[b : b + n + max(round(p * n) for p in lengths)]
            ends = np.cumsum([len(w) + 1 for w in own]) - 1  # of the text joined by blanks
            far = pattern.distances(" ".join(own))
            each = [far[ends[min(n + round(p * n), len(own)) - 1]] for p in lengths] if own else [pattern.n]
            # other stretches are nearer than the first one by the words between their ends at most, about a fifth of the item
            if k == 0 and min(each) > bound + -(-pattern.n // 5):
                return None
            now = min(each), b, 1 - min(each) / pattern.n
            best = now if best is None else min(best, now)
        return best if best[0] <= bound else None


def held(docs: DataFrame, bench: Bench, most_edits: float) -> DataFrame:
    """FOUND rows of the places in documents (doc_id, text) that hold an item."""
    sent = docs.sparkSession.sparkContext.broadcast(bench)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = sent.value, word_memo()
        patterns: dict[int, Pattern] = {}
        for b in (part.slice(lo, SLICE) for part in batches for lo in range(0, part.num_rows, SLICE)):
            ids, texts, rows = b.column("doc_id").to_pylist(), [words_of(t.as_py()) for t in b.column("text")], []
            for d, item, start in sorted(own.met(texts, known)):
                if item not in patterns:
                    patterns[item] = Pattern(own.texts[item])
                if place := own.best_place(item, patterns[item], start, texts[d], most_edits):
                    rows.append((ids[d], own.ids[item], place[1], place[0], place[2]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], [f.split()[0] for f in FOUND.split(", ")])

    return in_arrow(docs, "decontamination", run, FOUND)


def blocks(items: Iterable[tuple[int, list[str]]], n_repetitions: int, most_bytes: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items that have words, in lists of about most_bytes bytes of index, one item at least."""
    held, size = [], 0
    for item, words in items:
        if words:
            size += index_bytes(len(words), n_repetitions)
            if held and size > most_bytes:
                yield held
                held, size = [], index_bytes(len(words), n_repetitions)
            held.append((item, words))
    if held:
        yield held


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    most_edits: float = 0.25,
    n_repetitions: int = 160,
    n_samples: int = 3,
    block_bytes: int = 48 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, start_word, edits, similarity): the best place of every item in every document that holds it.

    Words are runs of letters, digits and underscores, in lower case; in scripts written without blanks each character is
    one. An item is held where a stretch of as many words, or up to an eighth more or fewer, is at an edit distance, in
    characters, of at most most_edits of the item's length; ties go to the first place. Items of fewer than five words are
    held where their words stand as they are. Whole texts are searched. Null and empty texts hold nothing, items that are
    null, have no id or no word aren't searched for; repeated rows are one row, and equal items each have theirs. Extra
    columns are ignored, empty tables give no rows.

    Candidates come from random walks, so of what lies within the bound nine tenths or more are found, not all: tested by size
    of item with up to a quarter of the words replaced, lost or added, and with a letter changed in up to half of them.
    More edits than that in an item, evenly spread, are within the bound if they are letters, and are found less often.

    The benchmark is read as a stream and broadcast in blocks of about block_bytes bytes of index, one pass over the
    documents for each, so no size of it breaks a task or the driver.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    asked = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    with Scratch(spark) as scratch:
        found = None
        for items in blocks(((r["item_id"], words_of(r["text"])) for r in asked.toLocalIterator()), n_repetitions, block_bytes):
            near = held(read, Bench(items, n_repetitions, n_samples), most_edits)
            best = near.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start_word", "similarity")).alias("b"))
            own = scratch.written(best.select("doc_id", "item_id", "b.start_word", "b.edits", "b.similarity"), "found", keep=True)
            found = own if found is None else found.unionByName(own)
    return spark.createDataFrame([], FOUND) if found is None else found
