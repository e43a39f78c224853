"""Lightest paths without the paths."""

import random

import pytest
from pyspark.sql import functions as F

from meshwork.operators import paths
from meshwork.sources.scratch import Scratch


def test_distances_alone_equal_those_of_paths_and_are_aggregated_by_hash(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(str(rng.randrange(30)), str(rng.randrange(30)), float(rng.randrange(6))) for _ in range(90)]
    edges = spark.createDataFrame(rows, "from_id string, to_id string, w double").coalesce(1)
    starts = spark.createDataFrame([("0",), ("1",)], "id string")
    full = {(r.start, r.end, r.distance) for r in paths.lightest_paths(starts, edges, F.col("w"), delta=4.0).collect()}
    plans, written = [], Scratch.written
    monkeypatch.setattr(Scratch, "written", lambda self, df, *how, **more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(self, df, *how, **more))
    found = paths.lightest_paths(starts, edges, F.col("w"), delta=4.0, with_path=False)
    assert found.columns == ["start", "end", "distance"] and {tuple(r) for r in found.collect()} == full and len(full) > 20
    assert any("HashAggregate" in p for p in plans) and not any("SortAggregate" in p for p in plans)
    with pytest.raises(ValueError, match="needs paths"):
        paths.lightest_paths(starts, edges, F.col("w"), potential=starts.withColumn("potential", F.lit(0.0)), with_path=False)
