"""Queries over chains, causes and impact, prints by place, the blackboard's rules, documents and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import bits, fingerprints
from ..functions.sql import register_functions
from ..operators import blackboard, causal, dag, documents, paths, relations, search
from .queries import _CAUSAL, _FIRST, _HAM, WITH_GRAPH, _prints, of, query
from .views import graph, transitions

# paths and causes


def _shown(found: DataFrame) -> DataFrame:
    return found.withColumns({"path": F.array_join("path", ">"), "amplification": F.round("amplification", 6), "confidence": F.round("confidence", 6)})


@query(f"""{WITH_GRAPH}, {_CAUSAL.format(least=0.3)} SELECT array_to_string(path, '>') AS path, round(amp, 6) AS amplification, round(conf, 6) AS confidence, depth
FROM causal WHERE s = 'click' AND node_id = 'purchase'""")
def trace_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paths.trace_chain(transitions(spark, sf_dir), "click", "purchase")
    return _shown(found).select("path", "amplification", "confidence", "depth")


@query(f"""{WITH_GRAPH}, {_CAUSAL.format(least=0.3).replace("from_id", "x_id").replace("to_id", "from_id").replace("x_id", "to_id")}, {_FIRST}
SELECT s AS effect, node_id AS cause, array_to_string(list_reverse(path), '>') AS path, depth FROM first WHERE rn = 1""")
def root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transitions(spark, sf_dir)
    found = paths.trace_root_causes(edges.select(F.col("to_id").alias("id")), edges)
    return found.select(F.col("start").alias("effect"), F.col("end").alias("cause"), F.array_join("path", ">").alias("path"), "depth")


@query(f"""{WITH_GRAPH}, {_CAUSAL.format(least=0.3)}, {_FIRST} SELECT s AS start, node_id AS target, round(amp, 6) AS amplification,
round(amp * CASE WHEN node_id = 'purchase' THEN 0.9 WHEN node_id = 'error' THEN 0.7 ELSE 0.5 END * conf, 6) AS criticality, round(3 * amp, 6) AS final_magnitude
FROM first WHERE rn = 1 AND amp >= 1.2""")
def butterflies_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transitions(spark, sf_dir)
    weight = spark.createDataFrame([("purchase", 0.9), ("error", 0.7)], "id string, criticality double")
    found = causal.detect_butterflies(edges.select(F.col("from_id").alias("id")), edges, weight, magnitude=3.0, ratio=1.2)
    return found.select("start", F.col("end").alias("target"), *[F.round(c, 6).alias(c) for c in ("amplification", "criticality", "final_magnitude")])


@query(f"""{WITH_GRAPH}, {_CAUSAL.format(least=0.3)}, {_FIRST}, c AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY amp DESC, path) AS k FROM first WHERE rn = 1 AND amp > 2 AND amp * 0.5 > 1),
w AS (SELECT s, string_agg(array_to_string(path, '>'), '|' ORDER BY k) AS worst FROM c WHERE k <= 5 GROUP BY s),
b AS (SELECT s, count(*) FILTER (amp >= 5)::BIGINT AS butterflies FROM first WHERE rn = 1 GROUP BY s)
SELECT b.s AS start, butterflies, coalesce(worst, '') AS critical_paths FROM b LEFT JOIN w ON w.s = b.s""")
def impact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transitions(spark, sf_dir)
    found = causal.analyze_impact(edges.select(F.col("from_id").alias("id")), edges, spark.createDataFrame([], "id string, criticality double"))
    worst = F.array_join(F.transform("critical_paths", lambda p: F.array_join(p, ">")), "|")
    return found.select("start", "butterflies", worst.alias("critical_paths"))


@query(f"""{WITH_GRAPH}, w AS (SELECT id AS s, id AS node_id, 0 AS d FROM nodes WHERE label = 'Region'
UNION SELECT w.s, e.to_id, w.d + 1 FROM w JOIN edges e ON e.from_id = w.node_id WHERE w.d < 3)
SELECT s AS start, d AS depth, count(*)::BIGINT AS n FROM (SELECT s, node_id, min(d) AS d FROM w GROUP BY ALL) GROUP BY ALL""")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    found = paths.shortest_paths(nodes.where("label = 'Region'").select("id"), edges, 3)
    return found.groupBy("start", "depth").agg(F.count("*").alias("n"))


@query(f"""{WITH_GRAPH}, {_CAUSAL.format(least=0)} SELECT s AS start, array_to_string(path, '>') AS path, depth FROM causal WHERE depth >= 1 AND amp >= 1.3
ORDER BY depth, amp DESC, path, s LIMIT 30""")
def traversal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path filter that includes its bound, in the default order."""
    edges = transitions(spark, sf_dir)
    found = paths.amplified(paths.expand(edges.select(F.col("from_id").alias("id")), edges, 1, 10), 1.3)
    return paths.in_traversal_order(found).select("start", F.array_join("path", ">").alias("path"), "depth").limit(30)


@query("""WITH q AS (SELECT event_type AS changed, CASE WHEN value > 20 THEN 'high' ELSE 'low' END AS affected FROM events), c AS (SELECT changed, affected, count(*) AS n FROM q GROUP BY ALL),
t AS (SELECT changed AS x, count(*) AS n FROM q GROUP BY x) SELECT changed AS from_id, affected AS to_id, 'CAUSES' AS type, round(c.n / t.n, 9) AS strength, c.n::BIGINT AS observations
FROM c JOIN t ON t.x = c.changed WHERE c.n / t.n > 0.3""")
def learned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("value") > 20, "high").otherwise("low")
    pairs = of(spark, sf_dir, "events").select(F.col("event_type").alias("changed"), level.alias("affected"))
    return causal.learn_edges(pairs).select("from_id", "to_id", "type", F.round("strength", 9).alias("strength"), "observations")


# prints by place


@query(f"""WITH {_prints('p', 'benchmark', 'item_id', 'text')}, r AS (SELECT id, w, list_transform(range(157), lambda i: (((w[(i - 1 + 157) % 157 + 1] & 288230376151711743::UBIGINT) << 6)
| (w[(i - 2 + 157) % 157 + 1] >> 58))::UBIGINT) AS t FROM p) SELECT id AS item_id, {_HAM.format(a='w', b='t')} AS distance FROM r""")
def print_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far prints are from themselves turned by 70 bits, after one turn there and one back."""
    own = of(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(fingerprints.sha_chain(F.col("text")))).alias("w"))
    turned = own.withColumn("t", bits.permute(bits.permute(bits.permute(F.col("w"), 70), 10048 - 70), 70))
    return turned.select("item_id", bits.hamming(F.col("w"), F.col("t")).alias("distance"))


@query(f"""WITH {_prints('c', 'nation', 'n_nationkey', 'n_name')}, k AS (SELECT n_regionkey AS r, c.w, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS place FROM c JOIN nation ON n_nationkey = c.id),
e AS (SELECT r, (i * 64 + b + place) % 10048 AS pl, (w[i + 1] >> b) & 1 AS x FROM k, range(157) t(i), range(64) u(b)),
v AS (SELECT r, pl, sum(x) AS c, count(*) AS n FROM e GROUP BY ALL) SELECT r AS n_regionkey, count(*) FILTER (2 * c > n)::INT AS ones, sum(CASE WHEN 2 * c > n THEN pl ELSE 0 END)::BIGINT AS places FROM v GROUP BY r""")
def print_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = of(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", fingerprints.sha_chain(F.col("n_name")).alias("words"))
    found = bits.sequenced(prints, "words", "n_nationkey", "n_regionkey")
    each = found.select("n_regionkey", F.posexplode("words").alias("i", "w")).select("n_regionkey", "i", "w", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b"))
    one = F.expr("shiftrightunsigned(w, b) & 1")
    return each.groupBy("n_regionkey").agg(F.sum(one).cast("int").alias("ones"), F.sum(one * (F.col("i") * 64 + F.col("b"))).cast("long").alias("places"))


def _mixed_sql(op: str) -> str:
    return f"list_transform(range(157), lambda i: (a.w[i + 1] {op} b.w[i + 1])::UBIGINT)"


@query(f"""WITH {_prints('n', 'nation', 'n_nationkey', 'n_name')}, {_prints('g', 'region', 'r_regionkey', 'r_name')}, m AS (SELECT a.id, {_mixed_sql('|')} AS w FROM n a JOIN nation ON n_nationkey = a.id JOIN g b ON b.id = n_regionkey),
d AS (SELECT m.id AS query_id, g.id AS id, {_HAM.format(a='m.w', b='g.w')} AS distance FROM m, g), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS k FROM d)
SELECT query_id, id, distance FROM r WHERE k = 1""")
def print_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest region of a nation's print laid over its region's."""
    region = of(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), fingerprints.sha_chain(F.col("r_name")).alias("words"))
    nation = of(spark, sf_dir, "nation").join(region.select(F.col("id").alias("n_regionkey"), F.col("words").alias("r")), "n_regionkey")
    noisy = nation.select(F.col("n_nationkey").alias("id"), bits.either(fingerprints.sha_chain(F.col("n_name")), F.col("r")).alias("words"))
    return search.nearest_anchor(noisy, region).select("query_id", "id", "distance")


@query(f"""WITH {_prints('n', 'nation', 'n_nationkey', 'n_name')}, {_prints('g', 'region', 'r_regionkey', 'r_name')}, m AS (SELECT a.id, {_mixed_sql('&')} AS w, {_mixed_sql('|')} AS v FROM n a JOIN nation ON n_nationkey = a.id JOIN g b ON b.id = n_regionkey)
SELECT id, list_sum(list_transform(w, lambda x: bit_count(x)::INT))::INT AS both_ones, list_sum(list_transform(v, lambda x: bit_count(x)::INT))::INT AS either_ones FROM m""")
def print_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = of(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.explode(F.array(fingerprints.sha_chain(F.col("r_name")))).alias("r"))
    pairs = of(spark, sf_dir, "nation").join(region, "n_regionkey").select(F.col("n_nationkey").alias("id"), "r", F.explode(F.array(fingerprints.sha_chain(F.col("n_name")))).alias("n"))
    ones = lambda f: bits.popcount(f(F.col("n"), F.col("r")))
    return pairs.select("id", ones(bits.both).alias("both_ones"), ones(bits.either).alias("either_ones"))


@query(f"""WITH {_prints('q', 'benchmark', 'item_id', 'text')}, {_prints('c', 'nation', 'n_nationkey', 'n_name')}, d AS (SELECT q.id AS query_id, c.id, {_HAM.format(a='q.w', b='c.w')} AS distance FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS k FROM d) SELECT query_id, round(1 - avg(1 - distance / 10000), 9) AS novelty FROM r WHERE k <= 5 GROUP BY query_id""")
def print_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = of(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), fingerprints.sha_chain(F.col("text")).alias("words"))
    corpus = of(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), fingerprints.sha_chain(F.col("n_name")).alias("words"))
    return search.novelty(search.hamming_join(asked, corpus, 5), asked).withColumn("novelty", F.round("novelty", 9))


@query(f"""WITH {_prints('c', 'nation', 'n_nationkey', 'n_name')}, {_prints('q', "(SELECT 1 AS k, 'FRANCE' AS t)", 'k', 't')} SELECT c.id AS id, {_HAM.format(a='q.w', b='c.w')} AS distance,
round(1 - {_HAM.format(a='q.w', b='c.w')} / 10000, 6) AS similarity FROM c, q WHERE c.id <> 0 UNION ALL SELECT 0, 10000, 0.0""")
def sql_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hamming() and similarity() as SQL functions; the print of nation 0 is null."""
    register_functions(spark)
    print_of = F.when(F.col("n_nationkey") != 0, bits.to_binary(fingerprints.sha_chain(F.col("n_name"))))
    prints = of(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), print_of.alias("p"))
    asked = spark.range(1).select(bits.to_binary(fingerprints.sha_chain(F.lit("FRANCE"))).alias("q"))
    return spark.sql("SELECT id, hamming(p, q) AS distance, round(similarity(p, q), 6) AS similarity FROM {prints} CROSS JOIN {asked}", prints=prints, asked=asked)


@query(f"""WITH {_prints('c', 'nation', 'n_nationkey', 'n_name')}, {_prints('q', "(SELECT 1 AS k, 'CHINA' AS t)", 'k', 't')}, d AS (SELECT c.id AS id, {_HAM.format(a='q.w', b='c.w')} AS distance FROM c, q)
SELECT id, distance FROM d ORDER BY distance, id LIMIT 7""")
def print_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = of(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), fingerprints.sha_chain(F.col("n_name")).alias("words"))
    return search.knn(corpus, fingerprints.sha_chain(F.lit("CHINA")), 7).select("id", "distance")


# blackboard and vocabularies


@query("""SELECT event_id, CASE WHEN event_id % 100 > 60 THEN 'continuation_agent' WHEN user_id % 7 = 0 THEN 'archaeologist' WHEN event_type = 'signup' THEN 'product_sage'
WHEN event_id % 5 >= 3 THEN 'fresh_perspective' END AS agent FROM events""")
def spawn_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("user_id") % 7 == 0, "rails").otherwise("web")
    rule = blackboard.spawn_rule(F.col("event_id") % 100, domain, F.col("event_type") == "signup", F.col("event_id") % 5)
    return of(spark, sf_dir, "events").select("event_id", rule.alias("agent"))


@query("""SELECT p_partkey, concat_ws('|', CASE WHEN p_partkey % 2 = 0 THEN 'acts_as_' END, CASE WHEN p_partkey % 3 = 0 THEN 'method_missing' END, CASE WHEN p_partkey % 5 = 0 THEN 'eval(' END,
CASE WHEN p_partkey % 7 = 0 THEN 'send(' END) AS found FROM part""")
def dangerous_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = of(spark, sf_dir, "part")
    n = F.col("p_partkey")
    code = F.concat_ws(" ", F.when(n % 7 == 0, "x.send(:y)"), F.when(n % 5 == 0, "eval(s)"), "p_name", F.when(n % 3 == 0, "def method_missing"), F.when(n % 2 == 0, "acts_as_list"))
    return parts.select("p_partkey", F.array_join(blackboard.dangerous(code), "|").alias("found"))


@query("""SELECT conv_id || '-' || turn AS id, md5(text) AS content FROM conversations WHERE role = 'user' ORDER BY turn DESC, id LIMIT 25""")
def messages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "Message:question").otherwise("Message:answer")
    nodes = rows.select(
        F.concat("conv_id", F.lit("-"), "turn").alias("id"), kind.alias("label"), F.col("text").alias("content"), F.to_json(F.struct(F.col("role").alias("from_agent"))).alias("properties"),
        F.timestamp_seconds("turn").cast("timestamp_ntz").alias("created_at"),
    )
    return blackboard.messages(nodes, "question", "user", 25).select("id", F.md5("content").alias("content"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'moved' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 7 <> 0""")
def update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    new = rows.where("id % 10 = 0").withColumn("segment", F.lit("moved")).unionByName(spark.createDataFrame([(-1, "new")], "id long, segment string"))
    return relations.delete_by_id(relations.update_by_id(rows, new), rows.where("id % 7 = 0"))


@query("""SELECT id, CASE WHEN label IN ('Thought', 'Concept', 'LearningMoment', 'Decision', 'Blocker') THEN label ELSE 'Node' END AS type FROM (SELECT event_id AS id,
CASE event_type WHEN 'click' THEN 'Thought' WHEN 'error' THEN 'Blocker' WHEN 'purchase' THEN 'Decision' ELSE event_type END AS label FROM events)""")
def node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    label = F.when(kind == "click", "Thought").when(kind == "error", "Blocker").when(kind == "purchase", "Decision").otherwise(kind)
    return of(spark, sf_dir, "events").select(F.col("event_id").alias("id"), schema.node_type(label).alias("type"))


@query("""SELECT vec_id, round(list_distance(embedding[1:7]::DOUBLE[], [0.1, 0.0, -0.1, 0.05, 0.0, 0.1, 0.0]::DOUBLE[]), 6) AS distance FROM embeddings
WHERE list_distance(embedding[1:7]::DOUBLE[], [0.1, 0.0, -0.1, 0.05, 0.0, 0.1, 0.0]::DOUBLE[]) < 0.3""")
def style_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 7).cast("array<double>").alias("style"))
    near = rows.withColumn("distance", schema.style_distance(F.col("style"), [0.1, 0.0, -0.1, 0.05, 0.0, 0.1, 0.0])).where("distance < 0.3")
    return near.select("vec_id", F.round("distance", 6).alias("distance"))


@query("""SELECT event_id, value > 50 AS positive, value > 0.7 AS intense, event_type = 'purchase' AS resolved, (event_id % 256 % 7)::INT AS dimension FROM events""")
def typed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.when(F.col("event_type") == "purchase", F.col("ts"))
    style = F.array_position(F.transform(blackboard.default_style(F.col("event_id") % 256), lambda x: x.cast("int")), 1) - 1
    return of(spark, sf_dir, "events").select(
        "event_id", blackboard.is_positive(F.col("value") - 50).alias("positive"), blackboard.is_intense(F.col("value")).alias("intense"),
        blackboard.is_resolved(kept).alias("resolved"), style.cast("int").alias("dimension"),
    )


@query("""SELECT p_partkey, concat_ws('|', CASE WHEN p_size > 20 THEN 'GOD_CLASS' END, CASE WHEN p_partkey % 90 > 50 THEN 'LONG_METHOD' END, CASE WHEN p_partkey % 11 > p_partkey % 5 THEN 'FEATURE_ENVY' END,
CASE WHEN p_partkey % 4 > 2 THEN 'DATA_CLUMP' END, CASE WHEN p_retailprice / 1500 > 0.8 THEN 'PRIMITIVE_OBSESSION' END, CASE WHEN p_partkey % 9 > 5 THEN 'SHOTGUN_SURGERY' END,
CASE WHEN p_partkey % 6 > 3 THEN 'DIVERGENT_CHANGE' END, CASE WHEN p_partkey % 2 > 0 THEN 'PARALLEL_INHERITANCE' END, CASE WHEN p_size < 3 THEN 'LAZY_CLASS' END) AS smells FROM part""")
def antipatterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smells of parts, measures made of their columns; one measure is missing."""
    n = F.col("p_partkey")
    measured = of(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").alias("method_count"), (n % 90).alias("lines"), (n % 11).alias("external_calls"), (n % 5).alias("internal_calls"),
        (n % 4).alias("repeated_param_groups"), (F.col("p_retailprice") / 1500).alias("primitive_ratio"), (n % 9).alias("change_fan_out"), (n % 6).alias("change_reasons"),
        (n % 2).alias("mirror_hierarchies"),
    )
    return blackboard.antipatterns(measured).select("p_partkey", F.array_join("smells", "|").alias("smells"))


@query("""WITH c AS (SELECT count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'click') AS t, count(*) FILTER (event_type = 'view' AND value > 1) AS h,
count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'error' AND value > 99) AS o, count(DISTINCT user_id) AS u FROM events)
SELECT 'spawn_rate' AS metric, round(s / t, 9) AS value, s / t > 0.3 AS met FROM c UNION ALL SELECT 'handover_completeness', round(h / a, 9), h / a > 0.95 FROM c
UNION ALL SELECT 'context_overflow_prevention', round(1 - o / u, 9), 1 - o / u > 0.99 FROM c""")
def compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    counts = of(spark, sf_dir, "events").agg(
        F.count_if(kind == "signup").alias("agent_spawns"), F.count_if(kind == "click").alias("significant_tasks"), F.count_if((kind == "view") & (value > 1)).alias("complete_handovers"),
        F.count_if(kind == "view").alias("total_handovers"), F.count_if((kind == "error") & (value > 99)).alias("overflows"), F.countDistinct("user_id").alias("sessions"),
    )
    return blackboard.compliance(counts).select("metric", F.round("value", 9).alias("value"), "met")


@query(f"""WITH {_prints('p', "(SELECT n_nationkey, 'a' || n_nationkey || ':' || CASE WHEN n_nationkey % 2 = 0 THEN 'None' ELSE n_name END || ':' || '{}' AS t FROM nation)", 'n_nationkey', 't')}
SELECT id AS agent, list_sum(list_transform(w, lambda x: bit_count(x)::INT))::INT AS ones FROM p""")
def agent_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = F.when(F.col("n_nationkey") % 2 != 0, F.col("n_name"))
    own = blackboard.agent_state_print(F.concat(F.lit("a"), "n_nationkey"), task, F.lit("{}"))
    return of(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("agent"), bits.popcount(own).alias("ones"))


@query(f"""{WITH_GRAPH} SELECT from_id || '--' || type || '-->' || to_id AS id FROM transitions""")
def edge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions(spark, sf_dir).select(blackboard.edge_key(F.col("from_id"), F.col("type"), F.col("to_id")).alias("id"))


# logs, documents, joins


@query("SELECT doc_id::VARCHAR AS id FROM documents ORDER BY doc_id::VARCHAR LIMIT 30 OFFSET 20")
def document_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.Documents(of(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))).slice(20, 50).rows



@query("SELECT event_type AS atom, count(*)::BIGINT AS calls, round(sum(value), 4) AS total_ns, round(avg(value), 6) AS mean_ns FROM events GROUP BY event_type")
def execution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dag.execution_stats(of(spark, sf_dir, "events").select(F.col("event_type").alias("atom"), F.col("value").alias("ns")))
    return found.withColumns({"total_ns": F.round("total_ns", 4), "mean_ns": F.round("mean_ns", 6)})


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00') WHERE n = 1""")
def replayed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = of(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    until = F.struct(F.lit("2024-01-15 00:00:00").cast("timestamp_ntz").alias("ts"), F.lit(1 << 62).alias("event_id"))
    return dag.replay(log, "user_id", "at", until).select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey % 8 AS lane, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
    return dag.lanes(rows).groupBy(F.col("lane").cast("long").alias("lane")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT doc_id::VARCHAR AS id, row_number() OVER (ORDER BY doc_id::VARCHAR) AS k, count(*) OVER () AS n FROM documents) SELECT id, k <= floor(0.8 * n) AS train FROM n""")
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents.Documents(of(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id")))
    train, rest = docs.split(0.8)
    return train.rows.withColumn("train", F.lit(True)).unionByName(rest.rows.withColumn("train", F.lit(False)))


@query("""SELECT coalesce(c.k, s.k) AS nation, coalesce(c.n, 0)::BIGINT AS customers, coalesce(s.n, 0)::BIGINT AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 8000 GROUP BY 1) c
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal < 3000 GROUP BY 1) s ON c.k = s.k""")
def full_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = of(spark, sf_dir, "customer").where("c_acctbal > 8000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = of(spark, sf_dir, "supplier").where("s_acctbal < 3000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full").fillna(0, ["customers", "suppliers"])


@query("""SELECT n_name AS nation, count(s_suppkey)::BIGINT AS suppliers, round(coalesce(sum(s_acctbal), 0), 2) AS balance FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name""")
def left_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = of(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    both = of(spark, sf_dir, "nation").join(rich, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return both.groupBy(F.col("n_name").alias("nation")).agg(F.count("s_suppkey").alias("suppliers"), F.round(F.coalesce(F.sum("s_acctbal"), F.lit(0.0)), 2).alias("balance"))
