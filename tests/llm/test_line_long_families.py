"""Families of long lines: bitmaps bound their pairs as they do those of short ones, and verifying a pair makes no row a shingle."""

import random

from pyspark.sql import functions as F

from meshwork.llm import line_dedup
from meshwork.llm.common import Scratch


def with_changes(line, rng, n):
    own = list(line)
    for at in rng.sample(range(len(own)), n):
        own[at] = rng.choice("ABCDEFGHIJ")
    return "".join(own)


def shingles(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def similar(a, b):
    return len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))


def test_long_lines_below_the_bound_are_not_verified(spark, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(60)]
    # words repeat, so a line has fewer different shingles than characters
    base = " ".join(rng.choices(words, k=140))
    lines = [with_changes(base, rng, 25) for _ in range(40)]
    lines.append(with_changes(lines[7], rng, 5))
    want = {(i, j) for j in range(len(lines)) for i in range(j) if similar(lines[i], lines[j])}
    assert (7, 40) in want
    texts = spark.createDataFrame(list(enumerate(lines)), "key long, line string")
    signed = line_dedup.sketched(line_dedup.signatures(texts, 5, 36), 9, 4).join(texts.select("key", F.lit(1).cast("long").alias("n")), "key").localCheckpoint()
    verified, compared = [], line_dedup.compared
    monkeypatch.setattr(line_dedup, "compared", lambda pairs, *how: verified.append(pairs.count()) or compared(pairs, *how))
    with Scratch(spark) as scratch:
        links = line_dedup.Links(scratch, texts, signed, 5, 0.8, 36)
        links.pairwise(signed.select(F.lit(1).cast("long").alias("band"), "key", F.col("key").alias("of"), "q0", "q1"))
        found = {tuple(r) for part in links.found for r in part.collect()}
        links.found.clear()
        verified.append(-sum(verified))
        links.by_rare_shingles(signed.select("key", "q0", "q1"))
        by_rare = {tuple(r) for part in links.found for r in part.collect()}
    assert found == by_rare == want
    # of 820 pairs, either way
    assert verified[0] < 60 and verified[2] < 60


def test_verifying_makes_one_row_a_pair(spark):
    rng = random.Random(9)
    lines = ["".join(rng.choices("ab ü\U0001f600", k=rng.randrange(1, 60))) for _ in range(20)]
    lines += [with_changes(x, rng, 1) for x in lines]
    texts = spark.createDataFrame(list(enumerate(lines)), "key long, line string")
    pairs = [(i, j) for j in range(len(lines)) for i in range(j)]
    found = line_dedup.compared(spark.createDataFrame(pairs, "a long, b long"), texts, 5, 0.8)
    assert {tuple(r) for r in found.collect()} == {(i, j) for i, j in pairs if similar(lines[i], lines[j])}
    assert "explode(sequence(" not in found._jdf.queryExecution().executedPlan().toString()
