"""Stateful streams against their batch forms after restarts; clustered tables and the files that reads open."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meshwork.operators import causal, zones
from meshwork.streaming import events as streams
from meshwork.streaming import stateful

START = dt.datetime(2024, 1, 1)


def event_rows(rng, n, first_id, lo, hi):
    """Rows in any order between two minutes of the day."""
    out = []
    for i in range(n):
        at = START + dt.timedelta(minutes=rng.randrange(lo, hi), seconds=rng.randrange(60))
        out.append((first_id + i, at, rng.randrange(12), rng.choice(["error", "purchase", "view"]), 1.0, "{}"))
    return out


def add(spark, rows, folder):
    spark.createDataFrame(rows, streams.EVENTS).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def two_waves(spark, tmp_path):
    """Events of two waves, the second with rows that come late but within the delay; a last event closes all deadlines."""
    rng = random.Random(2)
    first = event_rows(rng, 120, 0, 0, 300)
    second = event_rows(rng, 120, 1000, 292, 600) + [(1200, START + dt.timedelta(minutes=298), 3, "purchase", 1.0, "{}")]
    last = [(9999, START + dt.timedelta(days=2), 99, "view", 1.0, "{}"), (9998, START + dt.timedelta(days=2), 99, "purchase", 1.0, "{}")]
    return [first, second, last], f"{tmp_path}/in"


def test_overdue_blockers_after_a_restart(spark, two_waves, tmp_path):
    waves, folder = two_waves
    told = []
    for wave in waves:  # a query of its own for each wave, from the same checkpoint
        add(spark, wave, folder)
        found = stateful.overdue(streams.read_events(spark, folder), 45 * 60_000, "15 minutes")
        streams.append_to(found, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(180)
        told.append(spark.read.schema(stateful.OVERDUE).parquet(f"{tmp_path}/out").count())
    got = [tuple(r) for r in spark.read.schema(stateful.OVERDUE).parquet(f"{tmp_path}/out").collect()]
    batch = [tuple(r) for r in stateful.overdue(streams.with_time(spark.read.parquet(folder)), 45 * 60_000).collect()]
    assert len(batch) > 20 and sorted(got) == sorted(batch) and 0 < told[0] < told[1] < told[2]


def test_stream_join_equals_batch_join(spark, two_waves, tmp_path):
    waves, folder = two_waves
    waves[-1] += [(9997, START + dt.timedelta(days=2), 98, "error", 1.0, "{}")]
    for wave in waves:
        add(spark, wave, folder)
        of = lambda kind: streams.read_events(spark, folder).where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), "user_id", "ts")  # noqa: E731, B023
        streams.append_to(stateful.with_resolutions(of("error"), of("purchase"), "30 MINUTES", "15 minutes"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(180)
    events = streams.with_time(spark.read.parquet(folder))
    side = lambda kind: events.where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), "user_id", "ts")
    batch = stateful.with_resolutions(side("error"), side("purchase"), "30 MINUTES")
    shown = lambda df: sorted((r.blocker_id, r.resolution_id or -1) for r in df.where("blocker_id <> 9997").collect())
    got = spark.read.schema(batch.schema).parquet(f"{tmp_path}/out")
    assert shown(got) == shown(batch) and any(r == -1 for _, r in shown(batch)) and any(r > 0 for _, r in shown(batch))


def test_kept_counts_learn_the_same_edges(spark, tmp_path):
    rng = random.Random(3)
    kinds = ["a", "b", "c", "d"]
    pair = "changed string, affected string"
    all_pairs = []
    kept = stateful.KeptCounts(spark, f"{tmp_path}/counts")
    assert kept.counts().count() == 0 and kept.edges().count() == 0
    for _ in range(3):
        rows = [(rng.choice(kinds[:2]), rng.choice(kinds)) for _ in range(50)] + [(None, "a")]
        all_pairs += rows
        spark.createDataFrame(rows, pair).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        kept.start(spark.readStream.schema(pair).parquet(f"{tmp_path}/in"), f"{tmp_path}/check").awaitTermination(120)
    before = sorted(map(tuple, kept.counts().collect()))
    replayed = spark.createDataFrame(all_pairs[:51], pair)
    for batch in kept.versions():
        kept.merge(replayed, batch)
    assert sorted(map(tuple, kept.counts().collect())) == before and len(kept.versions()) == 2
    clean = spark.createDataFrame([p for p in all_pairs if p[0]], pair)
    assert sorted(map(tuple, kept.edges().collect())) == sorted(map(tuple, causal.learn_edges(clean).collect()))
    # a version that a crash left incomplete is written anew
    last = kept.versions()[-1]
    clean.limit(0).selectExpr("changed", "affected", "0L AS observations").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{tmp_path}/counts/v={last + 1}")
    assert kept.versions()[-1] == last
    kept.merge(spark.createDataFrame([("a", "z")], pair), last + 1)
    assert kept.counts().where("affected = 'z'").count() == 1 and kept.counts().agg(F.sum("observations")).first()[0] == 151


def test_range_reads_open_few_files(spark, tmp_path):
    rows = spark.range(40_000).select(
        F.col("id"), (F.abs(F.hash("id")) % 1000).cast("double").alias("x"), F.timestamp_seconds(1_700_000_000 + F.pmod(F.xxhash64("id"), F.lit(1_000_000))).alias("t"), F.expr("IF(id % 500 = 0, NULL, id % 977)").alias("n")
    )
    path = f"file://{tmp_path}/z"
    zones.write_clustered(rows, path, ["x", "t"], 64)
    assert zones.read_clustered(spark, path).count() == 40_000
    every = len(zones.read_clustered(spark, path).inputFiles())
    lo, hi = dt.datetime.fromtimestamp(1_700_300_000, dt.UTC), dt.datetime.fromtimestamp(1_700_400_000, dt.UTC)
    bounds = {"x": (200.0, 320.0), "t": (lo, hi)}
    found = zones.read_clustered(spark, path, bounds)
    want = rows.where((F.col("x") >= 200) & (F.col("x") <= 320) & (F.col("t") >= F.lit(lo)) & (F.col("t") <= F.lit(hi)))
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in want.collect()) and found.count() > 300
    assert every >= 50 and len(found.inputFiles()) < every / 5
    assert "PushedFilters: [IsNotNull(x)" in found._jdf.queryExecution().executedPlan().toString()
    assert zones.read_clustered(spark, path, {"x": (5000.0, None)}).count() == 0
    assert zones.read_clustered(spark, path, {"x": (None, 10.0)}).count() == rows.where("x <= 10").count()
    nulls = f"file://{tmp_path}/n"
    zones.write_clustered(rows, nulls, ["n"], 8)
    assert zones.read_clustered(spark, nulls, {"n": (5, 5)}).count() == rows.where("n = 5").count()
    zones.write_clustered(rows.limit(0), f"file://{tmp_path}/e", ["x"], 4)
    assert zones.read_clustered(spark, f"file://{tmp_path}/e", {"x": (0.0, 1.0)}).count() == 0
    with pytest.raises(TypeError):
        zones.write_clustered(rows.withColumn("s", F.lit("a")), f"file://{tmp_path}/s", ["s"], 4)
