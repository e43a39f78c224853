"""Lines of one family that are too different to be linked: bitmaps keep their pairs from being verified."""

import random

from pyspark.sql import functions as F

from meshwork.llm import line_dedup
from meshwork.llm.common import Scratch


def with_changes(line, rng, n):
    own = list(line)
    for at in rng.sample(range(len(own)), n):
        own[at] = rng.choice("ABCDEFGHIJ")
    return "".join(own)


def test_pairs_below_the_bound_are_not_verified_and_similar_ones_are_found(spark, monkeypatch):
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefghij klmnop", k=300))
    lines = [with_changes(base, rng, 6) for _ in range(60)]
    lines.append(with_changes(lines[7], rng, 2))
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    want = {(i, j) for j in range(len(lines)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert (7, 60) in want
    texts = spark.createDataFrame(list(enumerate(lines)), "key long, line string")
    signed = line_dedup.sketched(line_dedup.signatures(texts, 5, 36), 9, 4).join(texts.select("key", F.lit(1).cast("long").alias("n")), "key").localCheckpoint()
    verified, compared = [], line_dedup.compared
    monkeypatch.setattr(line_dedup, "compared", lambda pairs, *how: verified.append(pairs.count()) or compared(pairs, *how))
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    with Scratch(spark, tidy=True) as scratch:
        links = line_dedup.Links(scratch, texts, signed, 5, 0.8, 36)
        rows = signed.select(F.lit(1).cast("long").alias("band"), F.lit(0).alias("number"), "key", "n", "q0", "q1")
        assert line_dedup.compare_groups(rows, links).isEmpty()
        found = {tuple(r) for part in links.found for r in part.collect()}
        assert found == want
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before
    # of 1830 pairs of the family
    assert sum(verified) < 150
