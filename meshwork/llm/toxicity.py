"""Toxicity by weak supervision.

Voters are a fixed lexicon and word patterns (whole words, beginnings, ends) that are frequent in toxic and rare in clean
labelled rows. A generative model of the votes of all documents, a latent class with a rate for each voter and class, is
estimated by expectation maximisation; correlations of voters within a class are measured, and correlated voters share
one weight. The model's posteriors are the labels of a linear classifier, which gives the scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, Scratch, in_arrow, kept, text_of
from .pii import fit_logistic

WORD = re.compile(r"[^\W\d_]+")
#: Insults that vote whether or not labelled rows hold them (fixed values).
LEXICON = "idiot moron stupid scum loser pathetic worthless disgusting trash clown imbecile dumbass bastard retard asshole idiota imbécil estúpido crétin salaud connard abruti trottel arschloch dummkopf".split()
#: Toxic rows of the sample, not yet voted on twice, that a mined voter must add: the same on tables of any size.
LEAST_ADDED = 3
#: Texts whose patterns a task counts at a time.
SLICE = 100
#: Lengths of beginnings and ends of words that may become voters.
AFFIXES = (3, 4, 5, 6)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


#: A pattern votes from its first place in a text on, and apart from that, as voters of their own, from these counts of places on.
MANY = (2, 3)


def patterns_of(word: str) -> list[str]:
    """The patterns that a word shows: itself, ^beginnings and ends$."""
    return [word, *(f"^{word[:n]}" for n in AFFIXES if len(word) >= n), *(f"{word[-n:]}$" for n in AFFIXES if len(word) >= n)]


class Voters:
    """The patterns of voters that a word shows; words are looked up once and remembered."""

    def __init__(self, voters: list[str]):
        self.index = {p: i for i, p in enumerate(voters)}
        self.patterns = {p.rpartition(" ")[2] for p in voters}
        self.words = Memo(self.shown)

    def shown(self, word: str) -> tuple[str, ...]:
        return tuple(p for p in patterns_of(word) if p in self.patterns)

    def votes(self, text: str) -> list[int]:
        shown: Counter[str] = Counter()
        for w in WORD.findall(text.lower()):
            if hit := self.words[w]:
                shown.update(hit)
        return sorted(self.index[v] for v in counted(shown) if v in self.index)


def counted(shown: Counter[str]) -> list[str]:
    """The voters for which a text's patterns speak: each pattern, and "n pattern" for n places or more."""
    return [*shown, *(f"{n} {p}" for p, c in shown.items() if c > 1 for n in MANY if c >= n)]


def labelled_sample(labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, toxic) of labelled rows outside the held-out part, at most max_rows / 2 of each class, by hash of the id.

    Rows with null or other values are left out; an id with both labels counts as toxic.
    """
    own = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    part = lambda y: own.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2)
    return part(0).unionByName(part(1))


def pattern_counts(rows: DataFrame) -> DataFrame:
    """(pattern, toxic, clean): the number of documents of each class with a pattern, from (text, toxic) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part.slice(lo, SLICE) for part in batches for lo in range(0, part.num_rows, SLICE)):
            count: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for t, y in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
                shown: Counter[str] = Counter()
                for w, c in Counter(WORD.findall(t.as_py().lower())).items():
                    for p in set(patterns_of(w)):
                        shown[p] += c
                count[y].update(counted(shown))
            names = list(count[0] | count[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([count[y][p] for p in names], pa.int64()) for y in (1, 0))], ["pattern", "toxic", "clean"]
            )

    each = in_arrow(rows.select("text", "toxic"), "toxicity", run, "pattern string, toxic long, clean long")
    return each.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_voters(counts: DataFrame, n_toxic: int, n_clean: int, most: int, least: int = 3) -> list[str]:
    """The lexicon, and up to `most` patterns that hold in `least` toxic rows or more and in few clean ones.

    Of patterns that nest with as many toxic rows, the longest stays.
    """
    rate = (F.col("toxic") / max(1, n_toxic)) / (F.col("toxic") / max(1, n_toxic) + (F.col("clean") + 0.5) / (n_clean + 1))
    good = counts.where((F.col("toxic") >= least) & (rate >= 0.9)).orderBy(F.desc("toxic"), "clean", "pattern").limit(20 * most).collect()
    kept: list[tuple[str, int, int]] = []
    for r in sorted(good, key=lambda r: (-len(r["pattern"].strip("^$")), -r["toxic"], r["pattern"])):
        core = r["pattern"].strip("^$")
        if not any(core in k and r["toxic"] <= n + 1 and r["clean"] >= c for k, n, c in kept):
            kept.append((core, r["toxic"], r["clean"]))
    cores = {k for k, _, _ in kept}
    mined = [r["pattern"] for r in good if r["pattern"].strip("^$") in cores]
    return list(dict.fromkeys([*LEXICON, *mined]))[: len(LEXICON) + most]


def cover(taught: list[tuple[list[int], int, int]], n_voters: int, fixed: int, least: int, times: int = 2) -> list[int]:
    """The fixed voters, and those chosen one by one that add most toxic rows of (votes, toxic, n) seen fewer than `times`
    times so far, at least `least` of them: chance patterns of copied rows add none."""
    votes = np.zeros((len(taught), n_voters), dtype=bool)
    for k, (own, _, _) in enumerate(taught):
        votes[k, own] = True
    toxic, n = np.array([y == 1 for _, y, _ in taught], dtype=bool), np.array([c for _, _, c in taught], dtype=float)
    clean = (votes * (n * ~toxic)[:, None]).sum(0)
    chosen, seen = list(range(fixed)), votes[:, :fixed].sum(1)
    while True:
        gain = (votes * (n * (toxic & (seen < times)))[:, None]).sum(0)
        gain[chosen] = -1
        best = int(np.lexsort((clean, -gain))[0]) if n_voters > len(chosen) else -1
        if best < 0 or gain[best] < least:
            return sorted(chosen)
        chosen.append(best)
        seen = seen + votes[:, best]


def votes_of(docs: DataFrame, voters: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, votes): the numbers of the voters that a document's words make vote, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(("toxicity", *voters), partial(Voters, voters))
        for b in batches:
            hit = [own.votes(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(hit, pa.list_(pa.int32()))], ["doc_id", "votes"])

    own_columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return in_arrow(own_columns, "toxicity", run, "doc_id long, votes array<int>")


def weighed(votes: Column, weights: np.ndarray, bias: float) -> Column:
    """bias and the weights of the voters that vote, through the logistic function."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    total = F.aggregate(votes, F.lit(float(bias)), lambda a, i: a + F.get(table, i))
    return 1 / (1 + F.exp(-total))


class LabelModel:
    """Rates of the voters in each class, correlations within a class, and weights that share among correlated voters."""

    def __init__(self, rates: np.ndarray, prior: float, share: np.ndarray):
        self.rates, self.prior, self.share = rates, prior, share
        on, off = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        self.weights = (on - off) * share
        self.bias = math.log(prior / (1 - prior)) + float((off * share).sum())


def fit_label_model(patterns: DataFrame, known: np.ndarray, n_known: tuple[int, int], prior: float, rounds: int) -> LabelModel:
    """patterns: (votes, n) over all documents. known: documents of the labelled sample by class and voter that votes.

    The sample's rates are where the estimate starts and its prior; from all documents only a row for each voter, and for
    each pair of voters, comes to the driver.
    """
    n_voters = known.shape[1]
    total = patterns.agg(F.sum("n")).first()[0] or 0
    base = np.stack([(known[c] + (0.02, 1)[c]) / (n_known[c] + 8) for c in (0, 1)])
    rates, strength = np.clip(base, 1e-5, 0.999), min(sum(n_known), 2000) + 20
    model = LabelModel(rates, prior, np.ones(n_voters))
    for _ in range(rounds if total else 0):
        p = patterns.withColumn("p", weighed(F.col("votes"), model.weights, model.bias))
        mass = float(p.agg(F.sum(F.col("p") * F.col("n"))).first()[0] or 0)
        sums = np.zeros((2, n_voters))
        for r in p.select("p", "n", F.explode("votes").alias("i")).groupBy("i").agg(F.sum(F.col("p") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect():
            sums[:, r["i"]] = r["n"] - r["t"], r["t"]
        size = np.array([total - mass, mass])
        rates = np.clip((sums + strength * base) / (size[:, None] + strength), 1e-5, 0.999)
        model = LabelModel(rates, float(np.clip(mass / total, 0.005, 0.5)), model.share)
    return LabelModel(model.rates, model.prior, correlation_share(patterns, model, n_voters))


def correlation_share(patterns: DataFrame, model: LabelModel, n_voters: int) -> np.ndarray:
    """1 / (1 + the sum of a voter's correlations with others within the toxic class): equal voters count once together."""
    p = patterns.withColumn("t", weighed(F.col("votes"), model.weights, model.bias) * F.col("n"))
    both = p.select("t", "votes", F.explode("votes").alias("i")).select("t", "i", F.explode("votes").alias("j")).groupBy("i", "j").agg(F.sum("t").alias("t"))
    joint = np.zeros((n_voters, n_voters))
    for r in both.collect():
        joint[r["i"], r["j"]] = r["t"]
    size = float(p.agg(F.sum("t")).first()[0] or 0) + 1e-9
    mean = np.diag(joint) / size
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    related = (joint / size - np.outer(mean, mean)) / np.outer(spread, spread)
    related[np.diag(joint) < 3] = 0
    np.fill_diagonal(related, 0)
    return 1 / (1 + np.where(related > 0.3, related, 0).clip(0, 1).sum(1))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    max_rows: int = 20_000,
    most_voters: int = 96,
    rounds: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, whole texts.

    Voters are mined, and the classifier fitted, on at most max_rows labelled rows (a documented bound) whose
    crc32(doc_id) mod 4 is not 2; the label model sees the votes of all documents. Null and empty texts have no votes and
    the score of such; repeated rows score alike; extra columns, lang and source are never read. Without usable labels
    the lexicon votes with default rates, and an empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scored(scratch, docs, labels, threshold, max_rows, most_voters, rounds, id_col, text_col)


def scored(
    scratch: Scratch, docs: DataFrame, labels: DataFrame, threshold: float, max_rows: int, most_voters: int, rounds: int, id_col: str, text_col: str
) -> DataFrame:
    # at most max_rows rows of two numbers: bounded, so broadcast
    sample = F.broadcast(scratch.written(labelled_sample(labels, max_rows), "sample"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).join(sample, "doc_id")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_known = (size.get(0, 0), size.get(1, 0))
    share = {r["toxic"]: r["n"] for r in labels.where(~held_out()).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = float(np.clip(share.get(1, 0) / max(1, share.get(0, 0) + share.get(1, 0)), 0.01, 0.5)) if share else 0.05
    voters = choose_voters(pattern_counts(rows), n_known[1], n_known[0], most_voters)

    voted = scratch.written(votes_of(docs, voters, id_col, text_col), "votes", keep=True)
    # at most max_rows rows
    taught = [(r["votes"], r["toxic"], r["n"]) for r in voted.join(sample, "doc_id").groupBy("votes", "toxic").agg(F.count("*").alias("n")).collect()]
    useful = cover(taught, len(voters), len(LEXICON), LEAST_ADDED) if taught else list(range(len(voters)))
    voted = voted.withColumn("votes", F.array_intersect("votes", F.array(*map(F.lit, useful))))
    taught = [(sorted({*own} & {*useful}), y, n) for own, y, n in taught]
    patterns = scratch.written(voted.groupBy("votes").agg(F.count("*").alias("n")), "patterns")
    known = np.zeros((2, len(voters)))
    for own, y, n in taught:
        known[y, own] += n
    if not sum(n_known):
        known[1, : len(LEXICON)], n_known = 1, (2000, 20)  # as if 2,000 clean rows without any word of the lexicon were known
    model = fit_label_model(patterns, known, n_known, prior, rounds)

    # the linear classifier: presence of each voter against the posterior, classes weighed back to the prior
    if taught:
        x, y, weight = np.zeros((len(taught), len(voters) + 1)), np.zeros(len(taught)), np.zeros(len(taught))
        x[:, -1] = 1
        for k, (own, toxic, n) in enumerate(taught):
            x[k, own] = 1
            y[k] = 1 / (1 + math.exp(-max(-30, min(30, model.bias + model.weights[own].sum()))))
            weight[k] = n * (prior / max(1, n_known[1]) if toxic else (1 - prior) / max(1, n_known[0])) * sum(n_known)
        w = fit_logistic(x, y, weight, ridge=0.05)
    else:
        w = np.r_[model.weights, model.bias]
    score = weighed(F.col("votes"), w[:-1], w[-1])
    return voted.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
