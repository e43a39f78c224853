"""Graph, prints, search, columns, text, store and streams on small inputs: goldens, inverses, edge cases."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from meshwork import schema
from meshwork.functions import bits, fingerprints
from meshwork.operators import blackboard, causal, columns, dag, paths, relations, search, text
from meshwork.operators.documents import Documents
from meshwork.operators.patterns import edge, match, node
from meshwork.sources.store import connect, with_print
from meshwork.streaming import events as streams

DEMO = [
    ("config_change", "validation_rules", "CAUSES", 1.0), ("validation_rules", "database_schema", "AMPLIFIES", 2.0), ("database_schema", "cache_layer", "TRIGGERS", 1.5),
    ("cache_layer", "api_endpoints", "AMPLIFIES", 3.0), ("api_endpoints", "user_sessions", "TRIGGERS", 2.0), ("config_change", "cache_layer", "CAUSES", 1.0),
]
CRITICAL = [("config_change", 0.3), ("validation_rules", 0.5), ("database_schema", 0.8), ("cache_layer", 0.6), ("api_endpoints", 0.9), ("user_sessions", 1.0)]


@pytest.fixture(scope="module")
def demo(spark):
    edges = spark.createDataFrame([(*e, 0.8) for e in DEMO], "from_id string, to_id string, type string, amplification double, confidence double")
    return spark.createDataFrame(CRITICAL, "id string, criticality double"), edges


def start(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_effects_chains_and_causes_of_the_demo_graph(spark, demo):
    nodes, edges = demo
    got = {r.end: (r.depth, r.amplification, round(r.confidence, 5)) for r in paths.trace_effects(start(spark, "config_change"), edges).collect()}
    assert got == {"validation_rules": (1, 1.0, 0.8), "cache_layer": (1, 1.0, 0.8), "database_schema": (2, 2.0, 0.64), "api_endpoints": (2, 3.0, 0.64), "user_sessions": (3, 6.0, 0.512)}
    chains = [(r.depth, r.amplification, round(r.confidence, 5)) for r in paths.trace_chain(edges, "config_change", "user_sessions").collect()]
    assert chains == [(3, 6.0, 0.512), (5, 18.0, 0.32768)]
    causes = {r.end: r.depth for r in paths.trace_root_causes(start(spark, "user_sessions"), edges).collect()}
    assert causes == {"api_endpoints": 1, "cache_layer": 2, "database_schema": 3, "config_change": 3, "validation_rules": 4}
    found = causal.detect_butterflies(start(spark, "config_change"), edges, nodes).collect()
    assert [(r.end, round(r.criticality, 3)) for r in found] == [("user_sessions", 3.072)]
    impact = causal.analyze_impact(start(spark, "config_change", "user_sessions"), edges, nodes).orderBy("start").collect()
    assert (impact[0].reach, impact[0].max_depth, impact[0].max_amplification, impact[0].direct) == (5, 3, 6.0, 2)
    assert (impact[1].reach, impact[1].max_amplification, impact[1].critical_paths) == (0, 1.0, [])


def test_confidence_prunes_and_cycles_end(spark):
    chain = spark.createDataFrame([(str(i), str(i + 1), "CAUSES", 1.0, 0.8) for i in range(6)], "from_id string, to_id string, type string, amplification double, confidence double")
    assert paths.trace_effects(start(spark, "0"), chain).agg(F.max("depth")).first()[0] == 5
    ring = spark.createDataFrame([("a", "b", "X", None), ("b", "a", "X", 2.0), ("a", "a", "X", 3.0), ("a", "b", "Y", 4.0)], "from_id string, to_id string, type string, amplification double")
    got = sorted((r.end, r.depth, r.amplification) for r in paths.expand(start(spark, "a"), ring, 0, 5).collect())
    assert got == [("a", 0, 1.0), ("b", 1, 1.0), ("b", 1, 4.0)]
    assert {(r.end, r.depth) for r in paths.shortest_paths(start(spark, "0"), chain).collect()} == {(str(i), i) for i in range(7)}


def test_correlations_and_reinforcement(spark):
    pairs = [("A", "B")] * 3 + [("A", "C")] + [("B", "C")] * 2 + [("B", "D")]
    got = {(r.changed, r.affected): round(r.strength, 3) for r in causal.find_correlations(spark.createDataFrame(pairs, "changed string, affected string")).collect()}
    assert got == {("A", "B"): 0.75, ("B", "C"): 0.333}
    seen = spark.createDataFrame([("a", "b", 0.5, 0.8, 2), ("a", "b", 0.9, 0.3, 3), ("a", "c", 0.1, 0.8, 1)], "from_id string, to_id string, strength double, confidence double, at long")
    rows = {r.to_id: (r.strength, round(r.confidence, 2), r.observations) for r in causal.reinforced(seen, "at").collect()}
    assert rows == {"b": (0.5, 0.9, 2), "c": (0.1, 0.8, 1)}


def test_patterns_with_awkward_names(spark):
    nodes = spark.createDataFrame([("1", "Order", '{"k": 3, "n": "it\'s"}'), ("2", "Limit", '{"k": 4}'), ("3", "Order", None)], "id string, label string, properties string")
    edges = spark.createDataFrame([("1", "2", "T"), ("2", "3", "U"), ("3", "3", "T"), ("1", "9", "T")], "from_id string, to_id string, type string")
    assert [r.b_id for r in match(nodes, edges, [node("a", "Order", k=3, n="it's"), edge("T"), node("b")]).collect()] == ["2"]
    assert sorted(r.b_id for r in match(nodes, edges, [node("a", "Limit"), edge(direction="both"), node("b")]).collect()) == ["1", "3"]
    found = match(nodes, edges, [node("a", "Order"), edge("T", "U", hops=(0, 2)), node("b", "Order")], order_by=["a_id", "b_id"], skip=1, limit=1).collect()
    assert [(r.a_id, r.b_id, r.depth_0) for r in found] == [("1", "3", 2)]
    with pytest.raises(ValueError):
        match(nodes, edges, [node("a"), edge("T")])


def model_xorshift(content, n=157):
    import hashlib

    s, out, m = int.from_bytes(hashlib.sha256(content.encode()).digest()[:8], "big") or 0xDEADBEEF, [], (1 << 64) - 1
    for _ in range(n):
        s ^= (s << 13) & m
        s ^= s >> 7
        s ^= (s << 17) & m
        out.append(s)
    return out


def test_prints_and_their_algebra(spark):
    import hashlib

    df = spark.createDataFrame([("x",), ("y",), ("z",)], "t string").select("t", fingerprints.sha_chain(F.col("t")).alias("w"), fingerprints.xorshift(F.col("t"), mask=False).alias("s"))
    rows = {r.t: r for r in df.collect()}
    word = lambda t, i: int.from_bytes(hashlib.sha256(f"{t}:{i}".encode()).digest()[:8], "little")
    assert [v % (1 << 64) for v in rows["x"].w[:156]] == [word("x", i) for i in range(156)] and rows["x"].w[156] == word("x", 156) & 0xFFFF
    assert [v % (1 << 64) for v in rows["x"].s] == model_xorshift("x")
    whole = lambda w: sum((v % (1 << 64)) << (64 * i) for i, v in enumerate(w))
    a, n = whole(rows["x"].w), 64 * 157
    for shift in (0, 1, 63, 64, 65, 10047, -5):
        k = shift % n
        got = df.where("t = 'x'").select(bits.permute(F.col("w"), shift)).first()[0]
        assert whole(got) == ((a << k) | (a >> (n - k))) & ((1 << n) - 1)
    pair = df.alias("a").join(df.alias("b"), F.expr("a.t = 'x' and b.t = 'y'"))
    pair = pair.select(F.col("a.w").alias("a"), F.col("b.w").alias("b"))
    r = pair.select(bits.hamming("a", "b").alias("d"), bits.hamming_packed(bits.to_binary(F.col("a")), bits.to_binary(F.col("b"))).alias("p"), (bits.bind(bits.bind("a", "b"), "b") == F.col("a")).alias("i"),
                    (bits.from_binary(bits.to_binary(F.col("a"))) == F.col("a")).alias("r"), bits.hamming("a", F.lit(None).cast("array<bigint>")).alias("n")).first()
    assert r.d == r.p == (a ^ whole(rows["y"].w)).bit_count() and r.i and r.r and r.n == 10_000
    counts = [sum(whole(rows[t].w) >> i & 1 for t in "xyz") for i in range(10_000)]
    bundle = bits.bundled(df, "w").first().w
    assert whole(bundle) == sum(1 << i for i, c in enumerate(counts) if 2 * c > 3)
    assert bits.bundled(df.where("t < 'z'"), "w").select(bits.popcount(F.col("w"))).first()[0] == sum(1 for i in range(10_000) if whole(rows["x"].w) & whole(rows["y"].w) >> 0 & 0 or (whole(rows["x"].w) >> i & 1) + (whole(rows["y"].w) >> i & 1) == 2)
    assert bits.bound(df, "w").first().w == [x ^ y ^ z for x, y, z in zip(rows["x"].w, rows["y"].w, rows["z"].w, strict=True)]
    assert bits.most_distance(0.2) == 8000 and bits.most_distance(1.0) == 0
    level = spark.range(1).select(fingerprints.thermometer([F.lit(0.25), F.lit(1.0)], 400).alias("w"))
    assert level.select(fingerprints.thermometer_value(F.col("w"), 0, 400), fingerprints.thermometer_value(F.col("w"), 1, 400)).first() == (0.25, 1.0)


def test_search_ties_nulls_and_small_corpora(spark):
    corpus = spark.createDataFrame([("a", "same"), ("b", "same"), ("c", "other"), ("d", None)], "id string, t string").select("id", fingerprints.sha_chain(F.col("t")).alias("words"))
    query = fingerprints.sha_chain(F.lit("same"))
    assert [(r.id, r.distance) for r in search.knn(corpus, query, 10).collect()][:2] == [("a", 0), ("b", 0)]
    assert [r.id for r in search.resonate(corpus, query, 1.0).collect()] == ["a", "b"]
    assert search.hamming_join(corpus, corpus, 1).count() == 3
    docs = Documents.of(spark.createDataFrame([("1", "alpha"), ("2", "beta"), ("3", "")], "id string, content string"))
    assert docs.search("beta", 1).first().id == "2" and len(docs.delete(start(spark, "1"))) == 2
    assert [r.id for r in docs.query().like("alpha").at_least(0.9).limit(5).run().collect()] == ["1"]
    assert [len(x) for x in docs.split(0.7)] == [2, 1] and [len(x) for x in docs.split(0.0)] == [0, 3]
    many = Documents.of(spark.createDataFrame([(f"{i % 50:03}", "x") for i in range(200)], "id string, content string"))
    assert [len(x) for x in many.split(0.5)] == [100, 100] and many.split(0.5)[0].rows.agg(F.max("id")).first()[0] == "024"


def test_encodings_have_inverses(spark):
    rng = np.random.default_rng(3)
    values = [int(x) for x in rng.integers(-5, 5, 2500)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    column = columns.as_column(df, ["i"], "v", 1000)
    back = lambda d: [r.value for r in d.orderBy("pos").collect()]
    assert back(column) == values and [r.pos for r in column.orderBy("pos").collect()] == list(range(2500))
    assert back(columns.from_run_lengths(columns.run_lengths(column), 1000)) == values
    assert back(columns.from_deltas(columns.deltas(column))) == values
    assert back(columns.from_frame_of_reference(columns.frame_of_reference(column))) == values
    assert back(columns.from_dictionary(columns.dictionary_codes(column), columns.dictionary(column))) == values
    best = columns.encoding_choice(column).orderBy("chunk").first()
    assert (best.n_values, best.encoding, best.encoded_bytes) == (1000, "for", 500 + 9)
    stats = columns.chunk_stats(column)
    assert columns.prune_chunks(stats, 100).count() == 0 and columns.prune_chunks(stats, -5, 5).count() == 3


def test_chunkers(spark):
    assert text.split_text("abc\ndefgh", 5, 1) == ["abc\n", "\ndefg", "gh"] and text.split_text("", 5, 1) == [""]
    assert text.pack_paragraphs("One. " * 30 + "\n\nshort", 10, 50)[0].startswith("One.")
    assert text.pack_paragraphs("a" * 30 + "\n\n\n" + "b" * 30 + "\n\nc", 20, 70) == ["a" * 30 + "\n\n" + "b" * 30 + "\n\nc"]
    assert text.pack_paragraphs("short\n\n" + "b" * 60, 20, 50) == ["b" * 60] and text.pack_paragraphs("a" * 40 + "\n\n" + "b" * 60, 20, 50) == ["a" * 40, "b" * 60]
    assert text.pack_paragraphs("x. " * 40, 20, 50) == [("x. " * 17).strip(), ("x. " * 17).strip()]
    assert text.pack_paragraphs("", 10, 50) == []
    df = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None), (4, "x")], "id long, t string")
    assert [(r.id, r.chunk) for r in text.chunk_text(df, "id", "t").orderBy("id").collect()] == [(1, "a b c d e"), (2, ""), (4, "x")]
    assert [(r.id, r.chunk) for r in text.chunk_tokens(df, "id", "t", 3, 1).orderBy("id", "chunk_no").collect()] == [(1, "a b c"), (1, "c d e"), (4, "x")]


def test_levels_and_cycles(spark):
    tasks, pairs = start(spark, *"abcd"), [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "unknown")]
    assert dict(dag.dag_levels(tasks, spark.createDataFrame(pairs, "id string, depends_on string")).collect()) == {"a": 1, "b": 2, "c": 2, "d": 3}
    with pytest.raises(ValueError):
        dag.dag_levels(tasks, spark.createDataFrame([("a", "b"), ("b", "a")], "id string, depends_on string"))


def test_store_versions_and_parameters(spark, tmp_path):
    store = connect(spark, f"file://{tmp_path}/db")
    store.add_node("n1", "Config", content="it's")
    v = store.add_nodes(with_print(spark.createDataFrame([("n2", "Cache", "text", 7)], "id string, label string, content string, extra int"), F.col("content")))
    store.link("amplifies", "n1", "n2", 6.0)
    assert store.sql("SELECT id FROM nodes WHERE content = $t AND label = $t2", t="it's", t2="Config").first().id == "n1"
    assert store.edges.first().id == "n1->n2:AMPLIFIES" and store.butterflies("n1").first().amplification == 6.0
    assert store.impact("n2").first().max_amplification == 1.0 and store.resonate_content("text", 0.9).first().id == "n2"
    assert [r.id for r in store.checkout(v - 1).nodes.collect()] == ["n1"] and store.diff(v - 1, v).select("id", "change").collect() == [("n2", "added")]
    assert store.match([node("a"), edge("AMPLIFIES"), node("b", extra=7)], returns=["b_id"]).first().b_id == "n2"
    with pytest.raises(PermissionError):
        store.checkout(v).add_node("x", "Y")
    assert "NOT NULL" in schema.schema_to_ddl(schema.NODES, "nodes")


def test_blackboard_and_relations(spark):
    row = spark.createDataFrame([("Please REVIEW the design", 0.8, 0.6, "send(eval(x))")], "t string, s double, e double, c string")
    got = row.select(
        blackboard.route_task(F.col("t")), blackboard.route_task(F.col("t"), ["tester"]), blackboard.is_breakthrough(F.col("s"), F.col("e")), blackboard.dangerous(F.col("c")), blackboard.learning_qidx(F.col("s"))
    ).first()
    assert tuple(got) == ("reviewer", "orchestrator", True, ["eval(", "send("], 204)
    assert row.select(blackboard.danger_warnings(F.col("c")).alias("w")).first().w[1] == "send(: Dynamic dispatch - trace all paths"
    rules = [(61, "rails", True, 9, "continuation_agent"), (60, "rails", True, 9, "archaeologist"), (5, "web", True, 9, "product_sage"), (5, None, None, 3, "fresh_perspective"), (5, "web", False, 2, None)]
    spawned = spark.createDataFrame(rules, "p long, d string, u boolean, f long, want string").select(blackboard.spawn_rule(F.col("p"), F.col("d"), F.col("u"), F.col("f")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in spawned)
    marks = spark.createDataFrame([(0,), (31,), (32,), (160,), (255,), (256,), (None,)], "q long").select(schema.qidx_label(F.col("q")).alias("l")).collect()
    assert [r.l for r in marks] == ["crisis", "crisis", "struggling", "excited", "transcendent", "unknown", "unknown"]
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k long, t long")
    right = spark.createDataFrame([(1, 5, "e"), (1, 2, "b")], "k long, t long, v string")
    assert sorted((r.k, r.t, r.v or "") for r in relations.as_of_join(left, right, ["k"], "t", "t", ["v"]).collect()) == [(1, 1, ""), (1, 5, "e"), (2, 9, "")]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), i % 3, "view", 1.0, "{}") for i in range(0, 60, 5)]
    spark.createDataFrame(rows, streams.EVENTS).write.parquet(f"{tmp_path}/in")
    out = streams.windowed_counts(streams.read_events(spark, f"{tmp_path}/in"), "10 minutes")
    q = streams.append_to(out, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    batch = streams.windowed_counts(streams.with_time(spark.read.parquet(f"{tmp_path}/in")), "10 minutes")
    closed = {tuple(r) for r in spark.read.schema(batch.schema).parquet(f"{tmp_path}/out").collect()}
    assert closed and closed <= {tuple(r) for r in batch.collect()}


SMALL = ["trace_chain", "print_sequence", "split_documents", "pattern_1hop", "correlations", "degrees", "bind_xor", "chunk_stats", "rle_runs", "chunk_tokens", "grouping_sets", "as_of_views", "pivot_types"]


@pytest.mark.parametrize("name", SMALL)
def test_registered_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    want = con.sql(entry.oracle_sql()[name])
    order = sorted(got.columns)
    shown = lambda rows, names: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for _, v in sorted(zip(names, r, strict=True))) for r in rows)
    assert order == sorted(want.columns) and shown([tuple(r) for r in got.collect()], got.columns) == shown(want.fetchall(), want.columns)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
