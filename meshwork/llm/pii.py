"""Personal data by weak supervision.

Base spans follow fixed patterns. Further candidate spans come from wider patterns; regex, gazetteer and context
labelers vote on each (yes, no or abstain). Votes of all documents are counted by kind and vote pattern, expectation
maximisation estimates the labelers' reliabilities from the counts, and a logistic span classifier is fitted on
the posteriors. It decides which candidates become spans. Base spans always stay, whatever the votes say of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, text_of, written

#: Base kinds in their order, then the kinds that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("email_masked", "iban", "ssn", "secret")
# Base patterns (fixed values), written so that no text makes them take more than linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
# Wider patterns of the added kinds: what they match is a candidate only. Runs are taken whole, however long, and are never
# given back, so each text takes linear time; an IBAN has its format's length.
WIDE = {
    "email_masked": re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]++ ?(?:\[at\]|\(at\)|<at>) ?[A-Za-z0-9-]++ ?(?:\[dot\]|\(dot\)|<dot>|\.) ?[A-Za-z]{2,}+\b", re.A),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"),
}
#: Words before a span that speak for its kind (fixed values).
CUES = {
    "email_masked": ("mail", "contact", "write", "reach"), "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"), "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "password", "passwd", "apikey", "api_key", "key", "bearer", "auth", "credential"),
}
#: Words that speak against one (fixed values).
AGAINST = ("sha", "sha1", "sha256", "md5", "digest", "checksum", "commit", "hash", "isbn", "version", "example")
#: Top-level domains and first letters of bank countries (fixed values).
DOMAINS = frozenset("com org net edu gov io de fr es uk it nl eu info biz us ca au".split())
BANKS = frozenset("AT BE CH CY CZ DE DK EE ES FI FR GB GR HU IE IT LT LU LV MT NL NO PL PT RO SE SI SK".split())
#: How many characters before a candidate are its context.
CONTEXT = 32
LABELERS = ("shape", "entropy", "gazetteer", "cue", "assignment", "against")
#: How far each labeler is trusted before any vote is seen: shape and entropy hold for much that is no secret (fixed values).
TRUST = (0.6, 0.6, 0.7, 0.85, 0.85, 0.9)
FEATURES = ("bias", *LABELERS, "digits", "upper", "long")
SPANS = "array<struct<kind:int,start:int,stop:int,votes:string,features:array<double>>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every base span, by kind and then start. Python's str counts code points."""
    out, free = [], 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, free := m.end()))
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p) < 4 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def iban_rest(s: str) -> int:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def votes_on(kind: str, text: str, start: int, end: int) -> list[int]:
    """Each labeler's vote: 1 yes, 0 no, -1 abstain."""
    span, before = text[start:end], text[max(0, start - CONTEXT) : start].lower()
    words = re.findall(r"[a-z_0-9]+", before)[-4:]
    if kind == "secret":
        mixed = any(c.isdigit() for c in span) and any(c.isalpha() for c in span)
        shape, gazetteer = int(mixed) if "/" not in span else -1, 0 if span.count("-") > 3 or span.count("_") > 3 else -1
    elif kind == "iban":
        shape, gazetteer = int(iban_rest(span) == 1), int(span[:2] in BANKS)
    elif kind == "ssn":
        shape, gazetteer = int(span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000"), -1
    else:
        shape, gazetteer = 1, int(span.rpartition(".")[2].rpartition(" ")[2].lower() in DOMAINS) if "." in span else -1
    h = entropy(span)
    return [
        shape,
        (1 if h >= 3.3 else 0 if h < 2.5 else -1) if kind == "secret" else -1,
        gazetteer,
        1 if any(c in words for c in CUES[kind]) else -1,
        1 if re.search(r"[=:]\s*[\"']?$", before) else 0 if kind == "secret" else -1,
        0 if any(c in words for c in AGAINST) else -1,
    ]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[dict]:
    out, busy = [], [(s, e) for _, s, e in taken]
    for n, kind in enumerate(ADDED):
        if kind == "email_masked" and not any(x in text for x in ("[at]", "(at)", "<at>")):
            continue
        for m in WIDE[kind].finditer(text):
            start, end = m.span()
            if kind == "secret" and not any(c.isdigit() for c in m[0]):
                continue  # words, however long
            if any(s < end and start < e for s, e in busy):
                continue
            votes = votes_on(kind, text, start, end)
            size = end - start
            features = [1.0, *((v > 0) - (v == 0) for v in votes), round(sum(c.isdigit() for c in m[0]) / size, 1), float(m[0].isupper()), float(size >= 32)]
            out.append({"kind": len(BASE) + n, "start": start, "stop": end, "votes": "".join("01-"[v] for v in votes), "features": list(map(float, features))})
    return out


def extracted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, base, extra) of every document: base spans, and candidates with votes and features."""
    schema = f"doc_id long, base array<struct<kind:int,start:int,stop:int>>, extra {SPANS}"
    kinds = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))),
        ("extra", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("votes", pa.string()), ("features", pa.list_(pa.float64()))])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, extra = [], []
            for t in (x.as_py() for x in b.column("text")):
                found = base_spans(t)
                base.append([{"kind": k, "start": s, "stop": e} for k, s, e in found])
                extra.append(candidates(t, found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, kinds.field("base").type), pa.array(extra, kinds.field("extra").type)], schema=kinds)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return in_arrow(own, "pii", run, schema)


def estimate_reliabilities(patterns: dict[str, int], rounds: int = 50, trust: tuple[float, ...] | None = None) -> tuple[float, np.ndarray, dict[str, float]]:
    """Expectation maximisation over (vote pattern, count): the prior, each labeler's P(yes | true) and P(yes | false),
    and each pattern's posterior. Labelers are taken as independent given the truth; counts are smoothed, so that a
    labeler that always votes alike stays finite, and reliabilities start above chance, which fixes what "true" means."""
    votes = np.array([["01-".index(c) if c != "-" else -1 for c in p] for p in patterns])
    count = np.array(list(patterns.values()), dtype=float)
    first = np.array(trust or [0.75] * votes.shape[1])
    first = np.stack([first, 1 - first])
    prior, yes = 0.5, first.copy()
    posterior = np.full(len(count), 0.5)
    for _ in range(rounds):
        like = [np.where(votes == 1, np.log(yes[c]), np.where(votes == 0, np.log(1 - yes[c]), 0)).sum(1) for c in (0, 1)]
        odds = like[0] - like[1] + math.log(prior / (1 - prior))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        prior = float(np.clip(((posterior * count).sum() + 1) / (count.sum() + 2), 0.01, 0.99))
        for c, weight in enumerate((posterior * count, (1 - posterior) * count)):
            seen = (weight[:, None] * (votes >= 0)).sum(0)
            yes[c] = ((weight[:, None] * (votes == 1)).sum(0) + 4 * first[c]) / (seen + 4)
    return prior, yes, dict(zip(patterns, posterior.tolist(), strict=True))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, gradient)
    return w


def fit_span_models(found: DataFrame) -> dict[int, list[float]]:
    """A classifier for each added kind. Only counts of vote patterns and feature rows, both bounded, reach the driver."""
    each = found.select(F.explode("extra").alias("s")).groupBy("s.kind", "s.votes", "s.features").agg(F.count("*").alias("n")).collect()
    models = {}
    for kind in sorted({r["kind"] for r in each}):
        own = [r for r in each if r["kind"] == kind]
        patterns: Counter[str] = Counter()
        for r in own:
            patterns[r["votes"]] += r["n"]
        _, _, posterior = estimate_reliabilities(dict(patterns), trust=TRUST)
        x, y = np.array([r["features"] for r in own]), np.array([posterior[r["votes"]] for r in own])
        models[kind] = fit_logistic(x, y, np.array([r["n"] for r in own], dtype=float)).tolist()
    return models


def find_pii(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): all base spans, and all spans, as arrays of (kind, start, stop), ordered by kind and start.

    kind is an index into BASE + ADDED. Null and empty texts have no spans. Repeated rows each have their row; extra
    columns are ignored; with an empty table, or without candidates, nothing is fitted. A candidate that overlaps a base
    span is dropped. Texts are read once: spans and votes are kept in a table of the shared folder.
    """
    found = written(extracted(docs, id_col, text_col), "spans")
    models = fit_span_models(found)
    if models:
        weights = F.create_map(*[x for k, w in models.items() for x in (F.lit(k), F.array(*map(F.lit, w)))])
        margin = lambda s: F.aggregate(F.zip_with(s["features"], weights[s["kind"]], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        kept = F.filter("extra", lambda s: margin(s) >= math.log(threshold / (1 - threshold)))
    else:
        kept = F.filter("extra", lambda s: F.lit(False))
    plain = F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", plain)).alias("spans"))


def rendered(spans: str) -> Column:
    names = F.array(*map(F.lit, BASE + ADDED))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")
