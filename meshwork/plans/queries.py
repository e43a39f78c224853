"""Queries over graph, prints, vectors, columns and text. Each has SQL of the same result under its name where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, fingerprints, vectors
from ..operators import blackboard, causal, columns, dag, paths, relations, search, text
from ..operators.patterns import edge, match, node
from ..schema import qidx_label
from .views import EDGES_SQL, NODES_SQL, TRANSITIONS_SQL, graph, register, transitions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WITH_GRAPH = f"WITH RECURSIVE nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL}), transitions AS ({TRANSITIONS_SQL})"


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# graph patterns


@query(f"""{WITH_GRAPH} SELECT c.id AS c_id, c.amount AS c_amount, o.id AS o_id, o.amount AS o_amount FROM nodes c JOIN edges e ON e.from_id = c.id
JOIN nodes o ON o.id = e.to_id WHERE c.label = 'Customer' AND o.label = 'Order' AND e.type = 'PLACED' AND c.amount > 5000""")
def pattern_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    returns = ["c_id", "c_amount", "o_id", "o_amount"]
    return match(nodes, edges, [node("c", "Customer"), edge("PLACED"), node("o", "Order")], F.col("c_amount") > 5000, returns)


@query(f"""{WITH_GRAPH} SELECT n.name AS nation, count(*)::BIGINT AS orders, round(sum(o.amount), 2) AS amount FROM nodes n JOIN edges a ON a.from_id = n.id AND a.type = 'CONTAINS'
JOIN nodes c ON c.id = a.to_id AND c.label = 'Customer' AND c.name = 'BUILDING' JOIN edges b ON b.from_id = c.id AND b.type = 'PLACED'
JOIN nodes o ON o.id = b.to_id AND o.label = 'Order' WHERE n.label = 'Nation' GROUP BY n.name""")
def pattern_2hop_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    found = match(nodes, edges, [node("n", "Nation"), edge("CONTAINS"), node("c", "Customer", name="BUILDING"), edge("PLACED"), node("o", "Order")])
    return found.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("orders"), F.round(F.sum("o_amount"), 2).alias("amount"))


@query(f"""{WITH_GRAPH} SELECT id AS s_id, name AS s_name FROM nodes WHERE label = 'Supplier' AND (amount < 0 OR contains(name, '7')) AND NOT ends_with(name, '1') AND amount IS NOT NULL""")
def pattern_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    name, amount = F.col("s_name"), F.col("s_amount")
    return match(nodes, edges, [node("s", "Supplier")], ((amount < 0) | name.contains("7")) & ~name.endswith("1") & amount.isNotNull(), ["s_id", "s_name"])


@query(f"""{WITH_GRAPH} SELECT p.id AS p_id, count(*)::BIGINT AS n FROM edges e JOIN nodes o ON o.id = e.from_id AND o.label = 'Order' AND o.name = 'F'
JOIN nodes p ON p.id = e.to_id WHERE e.type = 'INCLUDES' GROUP BY p.id ORDER BY n DESC, p_id LIMIT 20 OFFSET 5""")
def pattern_order_skip_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    found = match(nodes, edges, [node("p", "Part"), edge("INCLUDES", direction="in"), node("o", "Order", name="F")])
    return found.groupBy("p_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_id").offset(5).limit(20)


_UNDIRECTED = "SELECT from_id, to_id, type FROM edges UNION ALL SELECT to_id, from_id, type FROM edges WHERE from_id <> to_id"


@query(f"""{WITH_GRAPH}, both_ways AS ({_UNDIRECTED}) SELECT m.label, count(*)::BIGINT AS n FROM nodes c JOIN both_ways e ON e.from_id = c.id JOIN nodes m ON m.id = e.to_id
WHERE c.label = 'Customer' AND e.type IN ('CONTAINS', 'PLACED') GROUP BY m.label""")
def pattern_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    found = match(nodes, edges, [node("c", "Customer"), edge("CONTAINS", "PLACED", direction="both"), node("m")])
    return found.groupBy(F.col("m_label").alias("label")).agg(F.count("*").alias("n"))


_WALK = """walk AS (SELECT id AS start_id, id AS node_id, [id] AS path, CAST(1.0 AS DOUBLE) AS amp, 0 AS depth FROM nodes WHERE {start}
UNION ALL SELECT w.start_id, e.to_id, list_append(w.path, e.to_id), w.amp * e.amplification, w.depth + 1 FROM walk w JOIN edges e ON e.from_id = w.node_id
WHERE w.depth < {most} AND NOT list_contains(w.path, e.to_id) AND e.type IN ('CONTAINS', 'PLACED', 'INCLUDES'))"""


@query(f"""{WITH_GRAPH}, {_WALK.format(start="id = 'n3'", most=3)} SELECT array_to_string(path, '>') AS path, round(amp, 6) AS amplification, depth, x.label AS m_label
FROM walk JOIN nodes x ON x.id = walk.node_id WHERE depth >= 1""")
def paths_1_to_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    found = match(nodes, edges, [node("n", "Nation", id="n3"), edge("CONTAINS", "PLACED", "INCLUDES", hops=(1, 3)), node("m")])
    return found.select(F.array_join("path_0", ">").alias("path"), F.round("amplification_0", 6).alias("amplification"), F.col("depth_0").alias("depth"), "m_label")


@query(f"""{WITH_GRAPH}, {_WALK.format(start="label = 'Region'", most=2)} SELECT start_id AS r_id, x.label AS m_label, count(*)::BIGINT AS n FROM walk JOIN nodes x ON x.id = walk.node_id
GROUP BY start_id, x.label""")
def paths_0_to_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    found = match(nodes, edges, [node("r", "Region"), edge("CONTAINS", "PLACED", "INCLUDES", hops=(0, 2)), node("m")])
    return found.groupBy("r_id", "m_label").agg(F.count("*").alias("n"))


_CAUSAL = """causal AS (SELECT DISTINCT from_id AS s, from_id AS node_id, [from_id] AS path, CAST(1.0 AS DOUBLE) AS amp, CAST(1.0 AS DOUBLE) AS conf, 0 AS depth FROM transitions
UNION ALL SELECT c.s, t.to_id, list_append(c.path, t.to_id), c.amp * t.amplification, c.conf * t.confidence, c.depth + 1 FROM causal c JOIN transitions t ON t.from_id = c.node_id
WHERE c.depth < 10 AND NOT list_contains(c.path, t.to_id) AND c.conf * t.confidence >= {least})"""


@query(f"""{WITH_GRAPH}, {_CAUSAL.format(least=0)} SELECT s AS start, array_to_string(path, '>') AS path, round(amp, 6) AS amplification, depth FROM causal WHERE depth >= 1 AND amp > 1.5""")
def butterfly_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transitions(spark, sf_dir)
    found = causal.butterfly_paths(edges.select(F.col("from_id").alias("id")), edges, 1.5)
    return found.select("start", F.array_join("path", ">").alias("path"), F.round("amplification", 6).alias("amplification"), "depth")


_FIRST = """first AS (SELECT *, row_number() OVER (PARTITION BY s, node_id ORDER BY depth, path, amp DESC) AS rn FROM causal WHERE depth >= 1)"""


@query(f"""{WITH_GRAPH}, {_CAUSAL.format(least=0.3)}, {_FIRST} SELECT s AS start, node_id AS target, array_to_string(path, '>') AS path, round(amp, 6) AS amplification,
round(conf, 6) AS confidence, depth FROM first WHERE rn = 1""")
def effects_first_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transitions(spark, sf_dir)
    found = paths.trace_effects(edges.select(F.col("from_id").alias("id")), edges)
    return found.select("start", F.col("end").alias("target"), F.array_join("path", ">").alias("path"), F.round("amplification", 6).alias("amplification"),
                        F.round("confidence", 6).alias("confidence"), "depth")


@query(f"""{WITH_GRAPH}, {_CAUSAL.format(least=0.3)}, {_FIRST} SELECT s AS start, count(*) FILTER (depth = 1)::BIGINT AS direct, count(*) FILTER (depth > 1)::BIGINT AS indirect,
count(*)::BIGINT AS reach, max(depth) AS max_depth, round(max(amp), 6) AS max_amplification FROM first WHERE rn = 1 GROUP BY s""")
def impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transitions(spark, sf_dir)
    starts = edges.select(F.col("from_id").alias("id"))
    found = causal.analyze_impact(starts, edges, starts.distinct().withColumn("criticality", F.lit(0.5)))
    return found.select("start", "direct", "indirect", "reach", "max_depth", F.round("max_amplification", 6).alias("max_amplification"))


@query("""WITH p AS (SELECT event_type AS changed, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS affected FROM events),
q AS (SELECT * FROM p WHERE affected IS NOT NULL), c AS (SELECT changed, affected, count(*) AS n FROM q GROUP BY ALL),
t AS (SELECT x, count(*) AS n FROM (SELECT changed AS x FROM q UNION ALL SELECT affected FROM q) GROUP BY x)
SELECT c.changed, c.affected, c.n::BIGINT AS observations, round(c.n / t.n, 9) AS strength FROM c JOIN t ON t.x = c.changed WHERE c.n / t.n > 0.1""")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["events"])
    pairs = spark.sql("SELECT event_type AS changed, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS affected FROM events")
    return causal.find_correlations(pairs.where("affected IS NOT NULL"), 0.1).withColumn("strength", F.round("strength", 9))


@query("""SELECT 's' || l_suppkey AS from_id, 'p' || l_partkey AS to_id, round(arg_min(l_discount, l_orderkey * 10 + l_linenumber), 4) AS strength,
round(least(1.0, 0.8 + 0.1 * (count(*) - 1)), 6) AS confidence, count(*)::BIGINT AS observations FROM lineitem GROUP BY l_suppkey, l_partkey""")
def edge_reinforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = of(spark, sf_dir, "lineitem")
    seen = lines.select(F.concat(F.lit("s"), "l_suppkey").alias("from_id"), F.concat(F.lit("p"), "l_partkey").alias("to_id"), F.col("l_discount").alias("strength"),
                        F.lit(0.8).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return causal.reinforced(seen, "at").withColumns({"strength": F.round("strength", 4), "confidence": F.round("confidence", 6)})


@query(f"""{WITH_GRAPH} SELECT x AS id, sum(o)::BIGINT AS fan_out, sum(i)::BIGINT AS fan_in FROM (SELECT from_id AS x, 1 AS o, 0 AS i FROM edges UNION ALL SELECT to_id, 0, 1 FROM edges) GROUP BY x""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.degrees(graph(spark, sf_dir)[1])


# prints

_WORDS = """list_transform(range(157), lambda i: ('0x' || substr(h[i + 1], 15, 2) || substr(h[i + 1], 13, 2) || substr(h[i + 1], 11, 2) || substr(h[i + 1], 9, 2) || substr(h[i + 1], 7, 2)
|| substr(h[i + 1], 5, 2) || substr(h[i + 1], 3, 2) || substr(h[i + 1], 1, 2))::UBIGINT & (CASE WHEN i = 156 THEN 65535 ELSE 18446744073709551615 END)::UBIGINT)"""


def _prints(name: str, source: str, key: str, identity: str) -> str:
    """SQL of a table (key, w) of sha-chain prints."""
    return f"""{name} AS (SELECT {key} AS id, {_WORDS} AS w FROM (SELECT {key}, list_transform(range(157), lambda i: substr(sha256({identity} || ':' || i), 1, 16)) AS h FROM {source}))"""


_HAM = "list_sum(list_transform(range(157), lambda i: bit_count(xor({a}[i + 1], {b}[i + 1]))::INT))::INT"


@query(f"WITH {_prints('p', 'benchmark', 'item_id', 'text')} SELECT id AS item_id, list_sum(list_transform(w, lambda x: bit_count(x)::INT))::INT AS ones FROM p")
def print_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, "benchmark").select("item_id", bits.popcount(fingerprints.sha_chain(F.col("text"))).alias("ones"))


@query(f"""WITH {_prints('q', 'benchmark', 'item_id', 'text')}, {_prints('c', 'nation', 'n_nationkey', 'n_name')},
d AS (SELECT q.id AS query_id, c.id AS id, {_HAM.format(a='q.w', b='c.w')} AS distance FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) SELECT query_id, id, distance, rank::INT AS rank FROM r WHERE rank <= 3""")
def hamming_join_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = of(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), fingerprints.sha_chain(F.col("text")).alias("words"))
    corpus = of(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), fingerprints.sha_chain(F.col("n_name")).alias("words"))
    return search.hamming_join(asked, corpus, 3).select("query_id", "id", "distance", "rank")


@query(f"""WITH {_prints('c', 'customer', 'c_custkey', 'c_mktsegment')}, {_prints('q', "(SELECT 1 AS k, 'BUILDING' AS t)", 'k', 't')}
SELECT c.id AS id, {_HAM.format(a='q.w', b='c.w')} AS distance FROM c, q WHERE {_HAM.format(a='q.w', b='c.w')} <= 4000""")
def resonate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = of(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), fingerprints.sha_chain(F.col("c_mktsegment")).alias("words"))
    return search.resonate(corpus, fingerprints.sha_chain(F.lit("BUILDING")), 0.6).select("id", "distance")


@query(f"""WITH {_prints('c', 'nation', 'n_nationkey', 'n_name')}, each AS (SELECT n_regionkey, i, w[i + 1] AS x FROM c JOIN nation ON n_nationkey = c.id, range(157) t(i)),
b AS (SELECT n_regionkey, i, bit_xor(x) AS x FROM each GROUP BY ALL) SELECT n_regionkey, sum(bit_count(x)::INT)::INT AS ones FROM b GROUP BY n_regionkey""")
def bind_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = of(spark, sf_dir, "nation").select("n_regionkey", fingerprints.sha_chain(F.col("n_name")).alias("words"))
    return bits.bound(prints, "words", "n_regionkey").select("n_regionkey", bits.popcount(F.col("words")).alias("ones"))


@query(f"""WITH {_prints('c', 'nation', 'n_nationkey', 'n_name')}, each AS (SELECT n_regionkey, i, b, (w[i + 1] >> b) & 1 AS x FROM c JOIN nation ON n_nationkey = c.id, range(157) t(i), range(64) u(b)),
v AS (SELECT n_regionkey, i, b, sum(x) AS c, count(*) AS n FROM each GROUP BY ALL) SELECT n_regionkey, count(*) FILTER (2 * c > n)::INT AS ones FROM v GROUP BY n_regionkey""")
def bundle_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = of(spark, sf_dir, "nation").select("n_regionkey", fingerprints.sha_chain(F.col("n_name")).alias("words"))
    return bits.bundled(prints, "words", "n_regionkey").select("n_regionkey", bits.popcount(F.col("words")).alias("ones"))


@query(f"""WITH {_prints('c', 'nation', 'n_nationkey', 'n_name')}, p AS (SELECT a.id AS x, b.id AS y, n.n_regionkey AS r, {_HAM.format(a='a.w', b='b.w')} AS d FROM c a JOIN nation n ON n.n_nationkey = a.id
JOIN nation m ON m.n_regionkey = n.n_regionkey JOIN c b ON b.id = m.n_nationkey AND a.id < b.id) SELECT r AS n_regionkey, round(avg(1 - d / 10000), 9) AS cohesion FROM p GROUP BY r""")
def cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = of(spark, sf_dir, "nation").select("n_regionkey", fingerprints.sha_chain(F.col("n_name")).alias("words"))
    return search.cohesion(prints, "n_regionkey").withColumn("cohesion", F.round("cohesion", 9))


@query()
def print_xorshift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts overflow in SQL engines that check them; tested against a Python model."""
    return of(spark, sf_dir, "benchmark").select("item_id", bits.popcount(fingerprints.xorshift(F.col("text"))).alias("ones"))


# vectors

_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)"


def _asked(spark: SparkSession, sf_dir: str) -> list[float]:
    return of(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"]


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_Q}), vec_id LIMIT 25")
def vector_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.vector_search(of(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 25, id_col="vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings WHERE label <> 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 25")
def vector_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.vector_search(of(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 25, id_col="vec_id", metric="cosine", where=F.col("label") != 3)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_prints('c', 'embeddings', 'vec_id', "('v' || vec_id)")}, {_prints('q', "(SELECT 1 AS k, 'v7' AS t)", 'k', 't')},
near AS (SELECT vec_id, label FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_Q}), vec_id LIMIT 50)
SELECT near.vec_id, {_HAM.format(a='q.w', b='c.w')} AS distance FROM near JOIN c ON c.id = near.vec_id, q ORDER BY distance, near.vec_id LIMIT 5""")
def hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = of(spark, sf_dir, "embeddings").withColumn("words", fingerprints.sha_chain(F.concat(F.lit("v"), "vec_id")))
    return search.hybrid_search(corpus, _asked(spark, sf_dir), fingerprints.sha_chain(F.lit("v7")), 5, id_col="vec_id").select("vec_id", "distance")


@query("""WITH m AS (SELECT label, i, avg(embedding[i + 1]::DOUBLE) AS x FROM embeddings, range(64) t(i) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label)
SELECT a.label AS label_a, b.label AS label_b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM c a JOIN c b ON a.label < b.label""")
def cosine_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = of(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    a, b = (centre.select(F.col("label").alias(f"label_{k}"), F.col("v").alias(f"v_{k}")) for k in "ab")
    return a.join(b, F.col("label_a") < F.col("label_b")).select("label_a", "label_b", F.round(vectors.cosine(F.col("v_a"), F.col("v_b")), 6).alias("cosine"))


# columns

_COLUMN = "SELECT floor((row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1) / 10000)::BIGINT AS chunk, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos, {value} AS value FROM lineitem"


def _column(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    return columns.as_column(of(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], value)


@query(f"""WITH c AS ({_COLUMN.format(value='l_quantity')}) SELECT chunk, count(*)::BIGINT AS n_values, min(value) AS min_value, max(value) AS max_value,
count(*) FILTER (value IS NULL)::BIGINT AS null_count, count(DISTINCT value)::BIGINT AS distinct_count FROM c GROUP BY chunk""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.chunk_stats(_column(spark, sf_dir, "l_quantity"))


@query(f"WITH c AS ({_COLUMN.format(value='l_orderkey')}) SELECT chunk, min(value) AS min_value, max(value) AS max_value FROM c GROUP BY chunk HAVING max(value) >= 3000 AND min(value) <= 9000")
def chunk_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.prune_chunks(columns.chunk_stats(_column(spark, sf_dir, "l_orderkey")), 3000, 9000).select("chunk", "min_value", "max_value")


@query(f"""WITH c AS ({_COLUMN.format(value='l_returnflag')}), n AS (SELECT *, CASE WHEN value IS NOT DISTINCT FROM lag(value) OVER w AND lag(pos) OVER w IS NOT NULL THEN 0 ELSE 1 END AS fresh FROM c
WINDOW w AS (PARTITION BY chunk ORDER BY pos)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY chunk ORDER BY pos) AS run FROM n)
SELECT chunk, run::BIGINT AS run, any_value(value) AS value, count(*)::BIGINT AS run_length FROM r GROUP BY chunk, run""")
def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.run_lengths(_column(spark, sf_dir, "l_returnflag"))


@query(f"WITH c AS ({_COLUMN.format(value='l_partkey')}) SELECT chunk, pos::BIGINT AS pos, (value - coalesce(lag(value) OVER (PARTITION BY chunk ORDER BY pos), 0))::BIGINT AS delta FROM c")
def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.deltas(_column(spark, sf_dir, "l_partkey"))


@query(f"""WITH c AS ({_COLUMN.format(value='l_suppkey')}) SELECT chunk, pos::BIGINT AS pos, min(value) OVER w AS reference, value - min(value) OVER w AS "offset",
greatest(1, ceil(log2(max(value) OVER w - min(value) OVER w + 1)))::INT AS width FROM c WINDOW w AS (PARTITION BY chunk)""")
def for_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.frame_of_reference(_column(spark, sf_dir, "l_suppkey"))


@query(f"""WITH c AS ({_COLUMN.format(value='l_linestatus')}), f AS (SELECT chunk, value, min(pos) AS p FROM c GROUP BY ALL)
SELECT chunk, value, (row_number() OVER (PARTITION BY chunk ORDER BY p) - 1)::INT AS code FROM f""")
def dict_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.dictionary(_column(spark, sf_dir, "l_linestatus"))


@query()
def encoding_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against sizes reckoned in Python."""
    return columns.encoding_choice(_column(spark, sf_dir, "l_suppkey"))


# text


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, (greatest(0, ceil((len(w) - 256) / 224.0)) * 224 + 1)::BIGINT, 224)) AS b FROM t WHERE len(w) > 0)
SELECT doc_id, (b // 224)::INT AS chunk_no, len(w[b + 1:b + 256])::INT AS n_tokens, md5(array_to_string(w[b + 1:b + 256], ' ')) AS chunk FROM s""")
def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunk_tokens(of(spark, sf_dir, "documents"), "doc_id", "text").withColumn("chunk", F.md5("chunk"))


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, (greatest(0, ceil((length(text) - 512) / 448.0)) * 448 + 1)::BIGINT, 448)) AS b FROM documents WHERE length(text) > 0)
SELECT doc_id, (b // 448)::INT AS chunk_no, md5(substr(text, b + 1, 512)) AS chunk FROM s""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.fixed_windows(of(spark, sf_dir, "documents"), "doc_id", "text").withColumn("chunk", F.md5("chunk"))


@query()
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of greedy packing; tested on small texts."""
    return text.chunk_text(of(spark, sf_dir, "documents"), "doc_id", "text", semantic=True)


# blackboard, dependencies


@query("""SELECT b.event_id AS id FROM events b WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'purchase' AND s.user_id = b.user_id AND s.ts > b.ts)""")
def anti_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are blockers; a later purchase of the same user resolves all before it."""
    events = of(spark, sf_dir, "events")
    blockers = events.where("event_type = 'error'").select(F.col("event_id").alias("id"), F.lit("Blocker").alias("label"), "user_id", "ts")
    last = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("until"))
    solved = blockers.join(last, "user_id").where("ts < until").select(F.lit("RESOLVES").alias("type"), F.col("id").alias("to_id"))
    return blackboard.active_blockers(blockers, solved).select("id")


@query("""SELECT conv_id, turn, role, md5(text) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM conversations) WHERE n = 1""")
def latest_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of(spark, sf_dir, "conversations")
    return relations.latest_per(rows, ["conv_id"], [F.desc("turn"), F.col("role"), F.col("text")]).select("conv_id", "turn", "role", F.md5("text").alias("text"))


@query("""WITH m AS (SELECT max(ts) AS until FROM events) SELECT count(*)::BIGINT AS moments, round(avg(value), 6) AS mean_satisfaction, count(*) FILTER (value > 50)::BIGINT AS breakthroughs,
round(count(*) / 48.0, 6) AS velocity FROM events, m WHERE ts > until - interval '48 hours' AND ts <= until""")
def learning_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = of(spark, sf_dir, "events")
    until = events.agg(F.max("ts")).first()[0]
    moments = events.select(F.col("ts").alias("created_at"), F.col("value").alias("satisfaction"), (F.col("value") > 50).alias("is_breakthrough"))
    found = blackboard.learning_summary(moments, until, 48)
    return found.withColumns({"mean_satisfaction": F.round("mean_satisfaction", 6), "velocity": F.round("velocity", 6)})


@query("""WITH RECURSIVE d AS (SELECT p_partkey AS id, unnest([p_partkey // 2, p_partkey // 3]) AS on_id FROM part WHERE p_partkey > 1),
e AS (SELECT DISTINCT id, on_id FROM d WHERE on_id >= 1 AND on_id < id), w AS (SELECT p_partkey AS id, 0 AS level FROM part WHERE p_partkey NOT IN (SELECT id FROM e)
UNION SELECT e.id, w.level + 1 FROM w JOIN e ON e.on_id = w.id) SELECT id, max(level)::INT AS level FROM w GROUP BY id""")
def dag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = of(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    pairs = tasks.select("id", F.explode(F.array(F.floor(F.col("id") / 2), F.floor(F.col("id") / 3))).alias("depends_on"))
    return dag.dag_levels(tasks, pairs.where("depends_on >= 1 AND depends_on < id"))


@query("""SELECT event_id, CASE WHEN q BETWEEN 0 AND 31 THEN 'crisis' WHEN q BETWEEN 32 AND 63 THEN 'struggling' WHEN q BETWEEN 64 AND 95 THEN 'working' WHEN q BETWEEN 96 AND 127 THEN 'flowing'
WHEN q BETWEEN 128 AND 159 THEN 'engaged' WHEN q BETWEEN 160 AND 191 THEN 'excited' WHEN q BETWEEN 192 AND 223 THEN 'breakthrough' WHEN q BETWEEN 224 AND 255 THEN 'transcendent' ELSE 'unknown' END AS label
FROM (SELECT event_id, event_id % 260 AS q FROM events)""")
def qidx_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, "events").select("event_id", qidx_label(F.col("event_id") % 260).alias("label"))


@query("""SELECT conv_id, turn, CASE WHEN contains(t, 'excavate') OR contains(t, 'find') THEN 'archaeologist' WHEN contains(t, 'evaluate') OR contains(t, 'priority') THEN 'product_sage'
WHEN contains(t, 'learn') OR contains(t, 'capture') THEN 'meta_learner' WHEN contains(t, 'review') THEN 'reviewer' ELSE 'developer' END AS agent
FROM (SELECT conv_id, turn, lower(text || ' ' || ['Find', 'priority', 'capturing', 'Reviews', 'code'][(turn % 5)::INT + 1]) AS t FROM conversations)""")
def route_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a word of a task put after them, as the texts are invented prose."""
    words = F.array(*map(F.lit, ("Find", "priority", "capturing", "Reviews", "code")))
    task = F.concat("text", F.lit(" "), F.get(words, (F.col("turn") % 5).cast("int")))
    return of(spark, sf_dir, "conversations").select("conv_id", "turn", blackboard.route_task(task).alias("agent"))
