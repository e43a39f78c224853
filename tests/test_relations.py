"""Range joins against brute force."""

from pyspark.sql import functions as F

from meshwork.operators import relations


def test_a_range_join_of_few_buckets_is_dealt_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(relations, "PAIRS_A_SALT", 1000)
    left = spark.range(2000).select("id", (F.col("id") % 7).cast("double").alias("x")).unionByName(spark.createDataFrame([(-1, None), (-2, 1.0), (-2, 1.0)], "id long, x double"))
    right = spark.range(40).select(F.col("id").alias("r"), (F.col("id") % 4 - 1.5).alias("lo"), (F.col("id") % 4 + 2.0).alias("hi")).unionByName(spark.createDataFrame([(99, 5.0, 5.0)], "r long, lo double, hi double"))
    found = relations.range_join(left, right, "x", "lo", "hi", 25.0)
    want = left.crossJoin(right).where("x >= lo and x < hi").select("id", "r")
    got = found.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.id, r.r) for r in got) == sorted(tuple(r) for r in want.collect())
    assert len({r.task for r in got}) == 4
