"""Bands of bounded size are compared in full, by sketches first."""

import random

from pyspark.sql import functions as F

from meshwork.llm import line_dedup
from meshwork.llm.common import Scratch


def test_bands_of_a_few_hundred_lines_are_not_split(spark, monkeypatch):
    rng = random.Random(3)
    lines = ["".join(rng.choices("abcdefghij klmnop", k=80)) for _ in range(200)]
    lines.append("X" + lines[17][1:])
    texts = spark.createDataFrame(list(enumerate(lines)), "key long, line string")
    signed = line_dedup.sketched(line_dedup.signatures(texts, 5, 36), 9, 4).join(texts.select("key", F.lit(1).cast("long").alias("n")), "key").localCheckpoint()
    verified, compared = [], line_dedup.compared
    monkeypatch.setattr(line_dedup, "compared", lambda pairs, *how: verified.append(pairs.count()) or compared(pairs, *how))
    with Scratch(spark) as scratch:
        links = line_dedup.Links(scratch, texts, signed, 5, 0.8, 36)
        rows = signed.select(F.lit(1).cast("long").alias("band"), F.lit(0).alias("number"), "key", "n", "q0", "q1")
        left = line_dedup.compare_groups(rows, links)
        assert left.isEmpty()
        assert {tuple(r) for found in links.found for r in found.collect()} == {(17, 200)}
    # of 20100 pairs of the band
    assert sum(verified) < 20
