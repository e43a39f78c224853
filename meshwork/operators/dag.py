"""Dependency graphs: levels by longest path, execution logs and their replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .relations import latest_per


def dag_levels(tasks: DataFrame, depends: DataFrame, most: int = 1000) -> DataFrame:
    """(id, level): 0 without dependencies, else one more than the greatest level of a dependency.

    tasks has id; depends has (id, depends_on). Unknown dependencies count as level 0. A cycle is an error. A round
    writes the tasks at the end of a path of so many dependencies, found from the round before.
    """
    ids = tasks.select("id").distinct()
    edges = written(depends.join(ids, "id", "left_semi").select("id", "depends_on").distinct(), "edges")
    risen = edges.select("id").distinct()
    levels = [ids.withColumn("level", F.lit(0))]
    for n in range(1, min(most, ids.count()) + 2):
        risen = written(risen, f"level{n}")
        if risen.isEmpty():
            return reduce(DataFrame.unionByName, levels).groupBy("id").agg(F.max("level").alias("level"))
        levels.append(risen.withColumn("level", F.lit(n)))
        risen = edges.join(risen.withColumnRenamed("id", "depends_on"), "depends_on").select("id").distinct()
    raise ValueError("the dependencies have a cycle")


def lanes(tasks: DataFrame, n: int = 8) -> DataFrame:
    return tasks.withColumn("lane", F.pmod("idx", F.lit(n)))


def execution_stats(log: DataFrame) -> DataFrame:
    """(atom, calls, total_ns, mean_ns) of log rows (atom, ns)."""
    return log.groupBy("atom").agg(F.count("*").alias("calls"), F.sum("ns").alias("total_ns"), F.avg("ns").alias("mean_ns"))


def replay(log: DataFrame, key: str, at: str, until: object) -> DataFrame:
    """The state at a time: each key's latest row up to then."""
    return latest_per(log.where(F.col(at) <= F.lit(until)), [key], [F.desc(at)])
