"""The shared tables as a property graph, for DataFrames and, in the same words, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import read

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

NODES_SQL = """
SELECT concat('r', r_regionkey) AS id, 'Region' AS label, r_name AS name, CAST(NULL AS DOUBLE) AS amount, 0.9 AS criticality FROM region
UNION ALL SELECT concat('n', n_nationkey), 'Nation', n_name, CAST(NULL AS DOUBLE), 0.8 FROM nation
UNION ALL SELECT concat('c', c_custkey), 'Customer', c_mktsegment, c_acctbal, 0.5 FROM customer
UNION ALL SELECT concat('s', s_suppkey), 'Supplier', s_name, s_acctbal, 0.7 FROM supplier
UNION ALL SELECT concat('o', o_orderkey), 'Order', o_orderstatus, o_totalprice, 0.4 FROM orders
UNION ALL SELECT concat('p', p_partkey), 'Part', p_brand, p_retailprice, 0.3 FROM part
"""
EDGES_SQL = """
SELECT concat('r', n_regionkey) AS from_id, concat('n', n_nationkey) AS to_id, 'CONTAINS' AS type, CAST(1.0 AS DOUBLE) AS amplification, CAST(1.0 AS DOUBLE) AS confidence FROM nation
UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey), 'CONTAINS', CAST(1.0 AS DOUBLE), CAST(1.0 AS DOUBLE) FROM customer
UNION ALL SELECT concat('n', s_nationkey), concat('s', s_suppkey), 'CONTAINS', CAST(1.0 AS DOUBLE), CAST(1.0 AS DOUBLE) FROM supplier
UNION ALL SELECT concat('c', o_custkey), concat('o', o_orderkey), 'PLACED', CAST(1.0 + o_totalprice / 5e5 AS DOUBLE), CAST(0.9 AS DOUBLE) FROM orders
UNION ALL SELECT concat('o', l_orderkey), concat('p', l_partkey), 'INCLUDES', CAST(1.0 + l_discount AS DOUBLE), CAST(0.8 AS DOUBLE) FROM lineitem
"""
#: Transitions between event types of one user's consecutive events, as causal edges.
TRANSITIONS_SQL = """
SELECT from_id, to_id, 'CAUSES' AS type, CAST(1.0 + n / 1000.0 AS DOUBLE) AS amplification, CAST(0.8 AS DOUBLE) AS confidence FROM (
  SELECT from_id, to_id, count(*) AS n FROM (
    SELECT event_type AS from_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_id FROM events) AS f
  WHERE to_id IS NOT NULL AND to_id <> from_id GROUP BY from_id, to_id) AS g
"""


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    for name in names or TABLES:
        read(spark, "parquet", f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    register(spark, sf_dir, ["region", "nation", "customer", "supplier", "orders", "lineitem", "part"])
    return spark.sql(NODES_SQL), spark.sql(EDGES_SQL)


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["events"])
    return spark.sql(TRANSITIONS_SQL)
