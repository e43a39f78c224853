"""The relational surface: what users of a SQL engine expect, on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relations
from ..streaming import events as streams
from .queries import of, query
from .views import register


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("""SELECT r_name, n_name, c_mktsegment, round(sum(o_totalprice), 2) AS total, count(*)::BIGINT AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def rollup_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of(spark, sf_dir, "orders").join(of(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(of(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(of(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.rollup("r_name", "n_name", "c_mktsegment").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, count(DISTINCT l_suppkey)::BIGINT AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("""SELECT c_nationkey, c_mktsegment, count(*)::BIGINT AS n, grouping(c_nationkey)::INT AS g FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ()) HAVING count(*) > 3""")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["customer"])
    return spark.sql("""SELECT c_nationkey, c_mktsegment, count(*) AS n, cast(grouping(c_nationkey) AS int) AS g FROM customer
                        GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ()) HAVING count(*) > 3""")


@query("""SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd,
lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""")
def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return of(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(w).alias("nt"),
        F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"), F.lag("o_totalprice").over(w).alias("before"),
        F.lead("o_totalprice").over(w).alias("after"),
    )


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving,
first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_type, count(*) OVER (PARTITION BY user_id) AS n FROM events""")
def window_frame_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return of(spark, sf_dir, "events").select(
        "event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 6).alias("moving"), F.first("event_type").over(w).alias("first_type"),
        F.count("*").over(Window.partitionBy("user_id")).alias("n"),
    )


@query("""SELECT user_id, 'both' AS side FROM (SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error')
UNION ALL SELECT user_id, 'only' FROM (SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup')""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_type = lambda t: of(spark, sf_dir, "events").where(F.col("event_type") == t).select("user_id")
    inner, less = of_type("purchase").intersect(of_type("error")), of_type("purchase").subtract(of_type("signup"))
    return inner.withColumn("side", F.lit("both")).unionByName(less.withColumn("side", F.lit("only")))


@query("""SELECT event_id, event_type, (props::JSON ->> '$.k')::INT AS k, md5(props) AS digest, coalesce(nullif(event_type, 'view'), 'seen') AS shown FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, "events").select(
        "event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), F.md5("props").alias("digest"),
        F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("seen")).alias("shown"),
    )


@query("""SELECT p.event_id, p.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def as_of_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last view at or before it."""
    events = of(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return relations.as_of_join(bought, seen, ["user_id"], "ts", "ts", ["view_id"]).select("event_id", "user_id", "view_id")


@query("""SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice >= s_acctbal AND p_retailprice < s_acctbal + 25""")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = of(spark, sf_dir, "supplier").withColumn("hi", F.col("s_acctbal") + 25)
    return relations.range_join(of(spark, sf_dir, "part"), bands, "p_retailprice", "s_acctbal", "hi", 25.0).select("p_partkey", "s_suppkey")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def distinct_on_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.latest_per(of(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("""SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_orderpriority""")
def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = of(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    poor = of(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = of(spark, sf_dir, "orders").join(back, "o_orderkey", "left_semi").join(poor, "o_custkey", "left_anti")
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'click')::BIGINT AS click, count(*) FILTER (event_type = 'purchase')::BIGINT AS purchase, count(*) FILTER (event_type = 'view')::BIGINT AS view
FROM events GROUP BY user_id""")
def pivot_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = of(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.count("event_id"))
    return wide.fillna(0)


@query("""SELECT event_type, median(value) AS med, round(quantile_cont(value, 0.9), 6) AS p90, round(stddev_samp(value), 6) AS sd, arg_max(event_id, value) AS top_id, bit_xor(event_id) AS bx,
string_agg(DISTINCT (user_id % 5)::VARCHAR, ',' ORDER BY (user_id % 5)::VARCHAR) AS users FROM events GROUP BY event_type""")
def aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, "events").groupBy("event_type").agg(
        F.median("value").alias("med"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"), F.round(F.stddev_samp("value"), 6).alias("sd"),
        F.max_by("event_id", "value").alias("top_id"), F.bit_xor("event_id").alias("bx"),
        F.array_join(F.array_sort(F.collect_set((F.col("user_id") % 5).cast("string"))), ",").alias("users"),
    )


@query("""SELECT event_id, date_trunc('month', ts) AS month, extract(dow FROM ts)::INT AS dow, strftime(ts, '%Y-%m') AS ym, split_part(event_type, 'c', 1) AS part, lpad(event_id::VARCHAR, 8, '0') AS padded,
date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS day, levenshtein(event_type, 'purchase')::INT AS edits FROM events""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, "events").select(
        "event_id", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), (F.dayofweek("ts") - 1).alias("dow"), F.date_format("ts", "yyyy-MM").alias("ym"),
        F.split_part("event_type", F.lit("c"), F.lit(1)).alias("part"), F.lpad(F.col("event_id").cast("string"), 8, "0").alias("padded"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"), F.levenshtein("event_type", F.lit("purchase")).alias("edits"),
    )


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w <= interval '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.sessions(streams.with_time(of(spark, sf_dir, "events")))
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 6).alias("total"))


@query("""SELECT time_bucket(interval '1 hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.windowed_counts(streams.with_time(of(spark, sf_dir, "events")))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""WITH n AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 15 <> 1)
SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT ALL SELECT c_custkey, c_name, c_acctbal FROM customer)
UNION ALL SELECT *, 'removed' FROM (SELECT c_custkey, c_name, c_acctbal FROM customer EXCEPT ALL SELECT * FROM n)""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = of(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.where("c_custkey % 15 <> 1").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return relations.snapshot_diff(old, new)
