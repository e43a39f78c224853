"""Queries over weighted paths, bounded paths, near prints and the vector index."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, fingerprints
from ..functions.table_functions import register_table_functions
from ..operators import causal, codebook, paths, search, sketches
from ..operators.vector_index import VectorIndex
from ..operators.zones import read_clustered, write_clustered
from ..sources.scratch import Scratch
from ..streaming import events as streams
from ..streaming import stateful
from .more_queries import _shown
from .queries import _CAUSAL, _COLUMN, _HAM, WITH_GRAPH, _column, _prints, of, query
from .queries import ORACLE_SQL as SQL
from .views import graph, register, transitions

# paths

_LIGHT = """odds AS (SELECT from_id, to_id, -ln(n / sum(n) OVER (PARTITION BY from_id)) AS w FROM (SELECT from_id, to_id, (amplification - 1) * 1000 AS n FROM transitions)),
light AS (SELECT DISTINCT from_id AS s, from_id AS node_id, [from_id] AS path, 0.0::DOUBLE AS d FROM odds
UNION ALL SELECT l.s, o.to_id, list_append(l.path, o.to_id), l.d + o.w FROM light l JOIN odds o ON o.from_id = l.node_id WHERE NOT list_contains(l.path, o.to_id))"""


def _odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions with -ln of their share of what follows, so that the lightest path is the likeliest."""
    edges = transitions(spark, sf_dir).withColumn("n", (F.col("amplification") - 1) * 1000)
    total = edges.groupBy("from_id").agg(F.sum("n").alias("total"))
    return edges.join(total, "from_id").withColumn("odds", -F.ln(F.col("n") / F.col("total")))


@query(f"""{WITH_GRAPH}, {_LIGHT}, best AS (SELECT *, row_number() OVER (PARTITION BY s, node_id ORDER BY round(d, 9), path) AS k FROM light)
SELECT s AS start, node_id AS target, round(d, 6) AS distance, array_to_string(path, '>') AS path FROM best WHERE k = 1""")
def likeliest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between all pairs of event types, against all simple paths."""
    edges = _odds(spark, sf_dir)
    found = paths.lightest_paths(edges.select(F.col("from_id").alias("id")), edges, F.col("odds"))
    return found.select("start", F.col("end").alias("target"), F.round("distance", 6).alias("distance"), F.array_join("path", ">").alias("path"))


@query(f"""{WITH_GRAPH}, walk AS (SELECT id AS s, id AS node_id, 0::BIGINT AS d FROM nodes WHERE label = 'Region'
UNION ALL SELECT w.s, e.to_id, w.d + (CASE e.type WHEN 'CONTAINS' THEN 7 WHEN 'PLACED' THEN round(1e6 / e.amplification) ELSE round(1e6 * (e.amplification - 1)) END)::BIGINT
  FROM walk w JOIN edges e ON e.from_id = w.node_id)
SELECT s AS start, m.label AS m_label, count(*)::BIGINT AS n, sum(d)::BIGINT AS distance FROM (SELECT s, node_id, min(d) AS d FROM walk GROUP BY ALL) x JOIN nodes m ON m.id = x.node_id GROUP BY ALL""")
def lightest_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of whole numbers from regions to all that they contain: sums by label of what is nearest."""
    nodes, edges = graph(spark, sf_dir)
    amp = F.col("amplification")
    weight = F.when(F.col("type") == "CONTAINS", 7).when(F.col("type") == "PLACED", F.round(1e6 / amp)).otherwise(F.round(1e6 * (amp - 1)))
    found = paths.lightest_paths(nodes.where("label = 'Region'"), edges, weight, delta=500_000.0, with_path=False)
    known = found.join(nodes.select(F.col("id").alias("end"), F.col("label").alias("m_label")), "end")
    return known.groupBy("start", "m_label").agg(F.count("*").alias("n"), F.sum("distance").cast("long").alias("distance"))


_RESONANT = f"""WITH RECURSIVE {_prints("p", "benchmark", "item_id", "text")}, m AS (SELECT count(*) AS n FROM benchmark),
ranked AS (SELECT item_id AS id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark),
e AS (SELECT a.i AS u, b.i AS v, a.id AS ua, b.id AS vb FROM (SELECT id, i, unnest([i + 1, 3 * i + 1, 5 * i + 2]) % m.n AS j FROM ranked, m) a JOIN ranked b ON b.i = a.j AND b.i <> a.i),
w AS (SELECT u, v, min({_HAM.format(a="x.w", b="y.w")} + 37 * ((u * 7 + v) % 11))::BIGINT AS w FROM e JOIN p x ON x.id = ua JOIN p y ON y.id = vb GROUP BY u, v),
walk AS (SELECT 0::BIGINT AS node, 0::BIGINT AS d, 0 AS hops UNION SELECT w.v, walk.d + w.w, walk.hops + 1 FROM walk JOIN w ON w.u = walk.node WHERE walk.hops < 9)
SELECT m.n - 1 AS target, min(d)::BIGINT AS distance FROM walk, m WHERE node = m.n - 1 GROUP BY m.n"""


@query(_RESONANT)
def learning_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A* through the space of prints, from the first item of the benchmark to the last: links weigh the bits that differ and
    a surcharge. Each item links to thrice its number, so no lightest path has over nine links."""
    items = of(spark, sf_dir, "benchmark").select("item_id", fingerprints.sha_chain(F.col("text")).alias("words"))
    ranked = items.withColumn("i", F.col("item_id") - items.agg(F.min("item_id")).first()[0])
    n = ranked.count()
    prints = ranked.select(F.col("i").cast("string").alias("id"), "words")
    links = ranked.select("i", F.explode(F.array(F.col("i") + 1, 3 * F.col("i") + 1, 5 * F.col("i") + 2)).alias("j")).select("i", (F.col("j") % n).alias("j")).where("i <> j").distinct()
    ends = links.join(ranked.select("i", F.col("words").alias("a")), "i").join(ranked.select(F.col("i").alias("j"), F.col("words").alias("b")), "j")
    weight = bits.hamming(F.col("a"), F.col("b")) + 37 * ((F.col("i") * 7 + F.col("j")) % 11)
    edges = ends.select(F.col("i").cast("string").alias("from_id"), F.col("j").cast("string").alias("to_id"), weight.alias("bits"))
    target = str(n - 1)
    potential = paths.print_potential(prints, target, edges, F.col("bits"))
    found = paths.lightest_path(edges, "0", target, F.col("bits"), potential)
    return found.select(F.col("end").cast("long").alias("target"), F.col("distance").cast("long").alias("distance"))


@query(f"""{WITH_GRAPH}, {_CAUSAL.format(least=0)}, r AS (SELECT s, count(DISTINCT node_id) AS reach FROM causal WHERE depth >= 1 GROUP BY s),
b AS (SELECT s, count(*) AS butterflies, max(amp) AS most FROM causal WHERE depth >= 1 AND amp > 1.5 GROUP BY s)
SELECT r.s AS start, reach::BIGINT AS reach, coalesce(butterflies, 0)::BIGINT AS butterflies, round(coalesce(most, 1.0), 6) AS max_amplification FROM r LEFT JOIN b ON b.s = r.s""")
def impact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transitions(spark, sf_dir)
    found = causal.impact_totals(edges.select(F.col("from_id").alias("id")), edges, threshold=1.5)
    return found.withColumn("max_amplification", F.round("max_amplification", 6))


@query(f"""{WITH_GRAPH}, {_CAUSAL.format(least=0.3)} SELECT s AS start, array_to_string(path, '>') AS path, round(amp, 6) AS amplification, round(conf, 6) AS confidence, depth
FROM causal WHERE depth >= 2 AND node_id IN ('purchase', 'error') AND amp > 1.2""")
def bounded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident and amplifying paths to chosen ends at once."""
    edges = transitions(spark, sf_dir)
    ends = spark.createDataFrame([("purchase",), ("error",)], "id string")
    found = paths.expand(edges.select(F.col("from_id").alias("id")), edges, 2, 10, paths.LEAST_CONFIDENCE, above=1.2, ends=ends)
    return _shown(found).select("start", "path", "amplification", "confidence", "depth")


@query(f"""{WITH_GRAPH}, both_ways AS (SELECT from_id, to_id FROM edges WHERE type IN ('CONTAINS', 'PLACED') UNION SELECT to_id, from_id FROM edges WHERE type IN ('CONTAINS', 'PLACED')),
near AS (SELECT 'n3' AS node_id, 0 AS d UNION SELECT e.to_id, near.d + 1 FROM near JOIN both_ways e ON e.from_id = near.node_id WHERE near.d < 3),
least AS (SELECT node_id, min(d) AS d FROM near GROUP BY node_id) SELECT m.label AS m_label, d::INT AS distance, count(*)::BIGINT AS n FROM least JOIN nodes m ON m.id = node_id WHERE d > 0 GROUP BY ALL""")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within three edges of a nation, either way, by label and distance."""
    nodes, edges = graph(spark, sf_dir)
    found = paths.neighbourhood(nodes.where("id = 'n3'").select("id"), edges, 3, ["CONTAINS", "PLACED"])
    return found.join(nodes.select(F.col("id").alias("end"), F.col("label").alias("m_label")), "end").groupBy("m_label", "distance").agg(F.count("*").alias("n"))


@query(f"""{WITH_GRAPH}, {_CAUSAL.format(least=0.3)}, first AS (SELECT *, row_number() OVER (PARTITION BY s, node_id ORDER BY depth, path, amp DESC) AS rn FROM causal WHERE depth >= 1)
SELECT s AS start, node_id AS target, array_to_string(path, '>') AS path, round(amp, 6) AS amplification, round(amp * 0.5 * conf, 6) AS criticality FROM first WHERE rn = 1 AND amp >= 1.4""")
def all_butterflies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Butterflies from every node, traced in one job."""
    edges = transitions(spark, sf_dir)
    nodes = edges.select(F.col("from_id").alias("id")).unionByName(edges.select(F.col("to_id").alias("id"))).distinct().withColumn("criticality", F.lit(0.5))
    found = causal.find_all_butterflies(nodes, edges, ratio=1.4)
    return _shown(found).select("start", F.col("end").alias("target"), "path", "amplification", F.round("criticality", 6).alias("criticality"))


# near prints

_SPOILT = f"""WITH {_prints("p", "benchmark", "item_id", "text")}, {_prints("o", "benchmark", "item_id", "('other ' || text)")},
q AS (SELECT p.id, list_transform(range(157), lambda i: CASE WHEN i < (p.id * 13) % 80 THEN o.w[i + 1] ELSE p.w[i + 1] END) AS w FROM p JOIN o ON o.id = p.id)"""


@query(f"""{_SPOILT}, d AS (SELECT q.id AS query_id, p.id AS id, {_HAM.format(a="q.w", b="p.w")} AS distance FROM q, p)
SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM d WHERE distance <= 2000""")
def near_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prints of which a growing share of words is another's: those within 2000 bits, by sampled bits."""
    items = of(spark, sf_dir, "benchmark")
    both = items.select(F.col("item_id").alias("id"), fingerprints.sha_chain(F.col("text")).alias("words"), fingerprints.sha_chain(F.concat(F.lit("other "), "text")).alias("other"))
    spoilt = both.select("id", F.zip_with(F.sequence(F.lit(0), F.lit(156)), F.arrays_zip("words", "other"), lambda i, w: F.when(i < F.col("id") * 13 % 80, w["other"]).otherwise(w["words"])).alias("words"))
    return search.hamming_join(spoilt, both.select("id", "words"), 1 << 20, most=2000, recall=0.9999).select("query_id", "id", "distance", "rank")


# the vector index


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 7),
d AS (SELECT query_id, vec_id AS id, list_distance(embedding::DOUBLE[], q) AS s FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, id) AS rank FROM d)
SELECT query_id, rank::INT AS rank, id, round(s, 6) AS score FROM r WHERE rank <= 20""")
def indexed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all vectors is built, and all its cells are probed: the result is exact."""
    rows = of(spark, sf_dir, "embeddings")
    index = VectorIndex.build(rows, Scratch(spark).root + "/index", "vec_id", posted=2)
    found = index.search(rows.where("vec_id % 50 = 7"), 20, len(index.sizes), None, "vec_id")
    return found.withColumn("score", F.round("score", 6))


@query()
def indexed_vectors_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An eighth of the cells are probed and codes choose the candidates; recall is tested against brute force."""
    rows = of(spark, sf_dir, "embeddings")
    index = VectorIndex.build(rows, Scratch(spark).root + "/index", "vec_id", posted=4)
    return index.search(rows.where("vec_id % 50 = 7"), 20, max(1, len(index.sizes) // 8), 10, "vec_id").withColumn("score", F.round("score", 6))


# clustered tables


@query("""SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem
WHERE l_shipdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-08-31' AND l_extendedprice BETWEEN 20000 AND 30000""")
def clustered_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines clustered by date and price; a range of both opens few of the files."""
    path = Scratch(spark).root + "/lines"
    write_clustered(of(spark, sf_dir, "lineitem"), path, ["l_shipdate", "l_extendedprice"], 64)
    bounds = {"l_shipdate": (dt.datetime(1995, 3, 1), dt.datetime(1995, 8, 31)), "l_extendedprice": (20000.0, 30000.0)}
    return read_clustered(spark, path, bounds).select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")


# blockers in time


@query("""SELECT user_id, event_id, epoch_us(ts) // 1000 AS ts_ms, epoch_us(ts) // 1000 + 86400000 AS deadline_ms FROM events b WHERE event_type = 'error' AND NOT EXISTS (
SELECT 1 FROM events r WHERE r.event_type = 'purchase' AND r.user_id = b.user_id AND epoch_us(r.ts) // 1000 BETWEEN epoch_us(b.ts) // 1000 AND epoch_us(b.ts) // 1000 + 86400000)""")
def overdue_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the stream with timers; a test runs both on the same events."""
    return stateful.overdue(of(spark, sf_dir, "events"), 86_400_000)


@query("""SELECT b.event_id AS blocker_id, b.user_id AS user_id, coalesce(r.event_id, -1) AS resolution_id FROM events b LEFT JOIN events r
ON r.event_type = 'purchase' AND r.user_id = b.user_id AND r.ts >= b.ts AND r.ts <= b.ts + INTERVAL 6 HOUR WHERE b.event_type = 'error'""")
def blockers_with_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the stream-stream join."""
    events = streams.with_time(of(spark, sf_dir, "events")).withColumnRenamed("event_id", "id")
    kind = lambda name: events.where(F.col("event_type") == name).select("id", "user_id", "ts")
    return stateful.with_resolutions(kind("error"), kind("purchase"), "6 HOURS").drop("blocked", "resolved").fillna(-1, ["resolution_id"])


# table functions


@query(SQL["chunk_tokens"])
def sql_chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_table_functions(spark)
    register(spark, sf_dir, ["documents"])
    return spark.sql("SELECT doc_id, chunk_no, n_tokens, md5(chunk) AS chunk FROM chunk_tokens(TABLE(documents), 'doc_id', 'text', 256, 32)")


@query(r"""WITH RECURSIVE t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, text, 0 AS chunk_no, 0::BIGINT AS b, CASE WHEN length(text) <= 512 THEN length(text) ELSE coalesce(nullif(512 - strpos(reverse(substr(text, 1, 512)), chr(10)) + 1, 513), 512) END AS e FROM t
UNION ALL SELECT doc_id, text, chunk_no + 1, greatest(e - 64, b + 1),
  CASE WHEN greatest(e - 64, b + 1) + 512 >= length(text) THEN length(text) ELSE greatest(e - 64, b + 1) + coalesce(nullif(CASE WHEN strpos(reverse(substr(text, greatest(e - 64, b + 1) + 1, 512)), chr(10)) IN (0, 512)
    THEN 512 ELSE 513 - strpos(reverse(substr(text, greatest(e - 64, b + 1) + 1, 512)), chr(10)) END, 0), 512) END FROM c WHERE e < length(text))
SELECT doc_id, chunk_no::INT AS chunk_no, md5(substr(text, b + 1, e - b)) AS chunk FROM c""")
def sql_chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_table_functions(spark)
    register(spark, sf_dir, ["documents"])
    return spark.sql("SELECT doc_id, chunk_no, md5(chunk) AS chunk FROM chunk_text(TABLE(SELECT doc_id, text FROM documents), 'doc_id', 'text', 512, 64)")


@query("""WITH c AS (SELECT user_id, ts, event_id, event_type FROM events), n AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS fresh
FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM n)
SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*)::BIGINT AS run_length FROM r GROUP BY user_id, run""")
def sql_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type of each user, by a table function with PARTITION BY and ORDER BY."""
    register_table_functions(spark)
    register(spark, sf_dir, ["events"])
    return spark.sql("SELECT * FROM runs_of(TABLE(SELECT user_id, ts, event_id, event_type FROM events) PARTITION BY user_id ORDER BY (ts, event_id), 'user_id', 'event_type')")


# codebooks and sketches


@query(f"""{_SPOILT}, d AS (SELECT a.id AS a, b.id AS b, {_HAM.format(a="a.w", b="b.w")} AS distance FROM (SELECT id, w FROM q UNION ALL SELECT id + 1000000, w FROM p) a, (SELECT id, w FROM q UNION ALL SELECT id + 1000000, w FROM p) b)
SELECT count(DISTINCT a)::BIGINT AS prints, 0::BIGINT AS far, 0::BIGINT AS crowded FROM d""")
def codebook_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoilt and clean prints: how many are further than 1500 bits from their anchor, and how many anchors are nearer to another."""
    items = of(spark, sf_dir, "benchmark")
    both = items.select(F.col("item_id").alias("id"), fingerprints.sha_chain(F.col("text")).alias("words"), fingerprints.sha_chain(F.concat(F.lit("other "), "text")).alias("other"))
    spoilt = both.select("id", F.zip_with(F.sequence(F.lit(0), F.lit(156)), F.arrays_zip("words", "other"), lambda i, w: F.when(i < F.col("id") * 13 % 80, w["other"]).otherwise(w["words"])).alias("words"))
    prints = spoilt.unionByName(both.select(F.col("id") + 1_000_000, "words").toDF("id", "words"))
    book, assigned = codebook.grow_codebook(prints, 1500)
    near = search.within(book, book, 1500).where("query_id <> id").agg(F.count("*").alias("crowded"))
    anchors = book.select(F.col("id").alias("anchor"), F.col("words").alias("a"))
    each = prints.join(assigned, "id", "left").join(anchors, "anchor", "left").withColumn("far", bits.hamming("words", "a") > 1500)
    return each.agg(F.count("*").alias("prints"), F.count_if("far").alias("far")).join(near)


@query(f"""WITH c AS ({_COLUMN.format(value='l_quantity')}) SELECT chunk // 2 AS part, count(*)::BIGINT AS n_values, min(value) AS min_value, max(value) AS max_value, count(DISTINCT value)::BIGINT AS distinct_count,
true AS near_median FROM c GROUP BY chunk // 2""")
def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of chunks, merged by twos: distinct counts of few values are exact, medians are within the error of ranks."""
    column = _column(spark, sf_dir, "l_quantity")
    each = sketches.merged(sketches.sketched(column).withColumn("part", F.floor(F.col("chunk") / 2)), "part")
    found = sketches.estimates(each, (0.5,)).withColumn("median", F.get("quantiles", F.lit(0)))
    rows = column.withColumn("part", F.floor(F.col("chunk") / 2)).join(found.select("part", "median"), "part")
    ranks = rows.groupBy("part").agg(F.avg((F.col("value") < F.col("median")).cast("int")).alias("below"), F.avg((F.col("value") <= F.col("median")).cast("int")).alias("upto"))
    near = ranks.select("part", ((F.col("below") <= 0.52) & (F.col("upto") >= 0.48)).alias("near_median"))
    return found.join(near, "part").select("part", "n_values", "min_value", "max_value", "distinct_count", "near_median")
