"""Table functions, growing codebooks, sketches and hub joins against plain Python."""

import random

import numpy as np
import pytest
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F

from meshwork.functions.table_functions import register_table_functions
from meshwork.operators import codebook, hubs, paths, search, sketches, text
from meshwork.operators.patterns import edge, match, node
from test_bounds_and_indexes import flipped, prints_of, random_words


@pytest.fixture
def tables(spark):
    register_table_functions(spark)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    texts = [None, "", " ", "one", "a b c d e", *[" ".join(rng.choices(words, k=rng.randrange(1, 400))).replace("w7 ", "w7\n") for _ in range(20)]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc long, body string, chunk string").repartition(3)
    df.createOrReplaceTempView("texts")
    return df


def test_chunkers_in_sql_equal_the_operators(spark, tables):
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.sql("SELECT * FROM chunk_tokens(TABLE(texts), 'doc', 'body', 30, 7)")) == rows(text.chunk_tokens(tables, "doc", "body", 30, 7))
    assert rows(spark.sql("SELECT * FROM chunk_text(TABLE(texts), 'doc', 'body', 100, 20)")) == rows(text.chunk_text(tables, "doc", "body", size=100, overlap=20))
    assert rows(spark.sql("SELECT * FROM chunk_text(TABLE(texts), 'doc', 'body', 100, 20, true)")) == rows(text.chunk_text(tables, "doc", "body", semantic=True, least=20, most=100))
    named = spark.sql("SELECT * FROM chunk_tokens(TABLE(SELECT body AS t, doc AS k FROM texts WHERE doc = 4), 'k', 't', overlap => 0, size => 2)")
    assert named.columns == ["k", "chunk_no", "n_tokens", "chunk"] and [r.chunk for r in named.orderBy("chunk_no").collect()] == ["a b", "c d", "e"]
    for wrong in ("TABLE(texts), 'doc', 'missing'", "TABLE(texts), 'doc', 'body', 5, 5", "TABLE(texts), 'doc', 'body', 0", "1, 'doc', 'body'"):
        with pytest.raises((AnalysisException, PythonException)):
            spark.sql(f"SELECT * FROM chunk_tokens({wrong})").collect()


def test_runs_by_partition(spark, tables):
    rows = [("k", i, v) for i, v in enumerate([1, 1, None, None, 2, 1])] + [("j", 0, 5)]
    spark.createDataFrame(rows, "key string, at int, value int").repartition(3).createOrReplaceTempView("readings")
    got = spark.sql("SELECT * FROM runs_of(TABLE(readings) PARTITION BY key ORDER BY (at), 'key', 'value')").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("k", 1, 1, 2), ("k", 2, None, 2), ("k", 3, 2, 1), ("k", 4, 1, 1), ("j", 1, 5, 1)], key=str)


def test_a_codebook_covers_and_keeps_apart(spark):
    rng = np.random.default_rng(2)
    base = random_words(rng, 6)
    rows = [(i, flipped(rng, base[i % 6], int(rng.integers(0, 900)))) for i in range(80)] + [(1000 + i, base[0]) for i in range(200)] + [(5000, None)]
    prints = prints_of(spark, rows).repartition(3)
    words = dict(rows)
    apart = lambda a, b: int(np.bitwise_count(a ^ b).sum())
    given = prints_of(spark, [(9000, base[3]), (9001, flipped(rng, base[3], 10))])
    for anchors, most in ((None, 1000), (given, 1000), (None, 4700)):
        book, assigned = codebook.grow_codebook(prints, most, anchors)
        held = {r.id: np.array(r.words, np.int64).view(np.uint64) for r in book.collect()}
        got = {r.id: (r.anchor, r.distance) for r in assigned.collect()}
        assert set(got) == {i for i, w in rows if w is not None}
        for i, (anchor, distance) in got.items():
            far = {a: apart(words[i], w) for a, w in held.items()}
            assert distance == far[anchor] <= most and (distance, anchor) == min((d, a) for a, d in far.items())
        made = [a for a in held if a < 9000]
        assert all(apart(held[a], held[b]) > most for a in made for b in held if a != b)
        assert anchors is None or {9000, 9001} <= set(held)
    book, assigned = codebook.grow_codebook(prints.limit(0), 1000)
    assert book.count() == 0 == assigned.count()


def test_leaders_follow_the_greedy_order(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(120)}
    pairs = {(a, b) for a, b in pairs if a != b}
    nodes = spark.range(60)
    links = spark.createDataFrame([(a, b) for a, b in pairs] + [(b, a) for a, b in pairs], "a long, b long")
    order = [r.id for r in nodes.orderBy(F.struct(F.xxhash64("id", F.lit(29)), "id")).collect()]
    with codebook.Scratch(spark) as scratch:
        got = {r.id for r in codebook.leaders(nodes, links, scratch).collect()}
    want = set()
    for n in order:
        if not any((n, m) in pairs or (m, n) in pairs for m in want):
            want.add(n)
    assert got == want


def test_sketches_merge_as_their_union(spark):
    rng = np.random.default_rng(4)
    values = [None if rng.random() < 0.02 else float(v) for v in rng.normal(0, 1000, 30_000).round(2)]
    column = spark.createDataFrame([(i // 2500, i, v) for i, v in enumerate(values)], "chunk long, pos long, value double").repartition(6)
    each = sketches.sketched(column)
    whole = sketches.estimates(sketches.merged(each), (0.1, 0.5, 0.9)).first()
    at_once = sketches.estimates(sketches.sketched(column.withColumn("chunk", F.lit(0))), (0.1, 0.5, 0.9)).first()
    known = np.array([v for v in values if v is not None])
    exact = len(set(known.tolist()))
    assert abs(whole.distinct_count - exact) < 0.05 * exact and abs(whole.distinct_count - at_once.distinct_count) <= 0.01 * exact
    assert (whole.n_values, whole.null_count, whole.min_value, whole.max_value) == (30_000, 30_000 - len(known), known.min(), known.max())
    for share, q in zip((0.1, 0.5, 0.9), whole.quantiles, strict=True):
        assert abs((known <= q).mean() - share) < 0.02
    some = sketches.estimates(sketches.merged(each.where("chunk in (2, 3)"))).first()
    part = [v for v in values[5000:10_000] if v is not None]
    assert some.min_value == min(part) and abs(some.distinct_count - len(set(part))) < 0.05 * len(part)
    few = spark.createDataFrame([(0, None), (1, 3.0), (1, 3.0)], "chunk long, value double")
    rows = {r.chunk: (r.distinct_count, r.quantiles) for r in sketches.estimates(sketches.sketched(few), (0.5,)).collect()}
    assert rows == {0: (0, None), 1: (1, [3.0])}


# hubs


@pytest.fixture(scope="module")
def star(spark):
    """A node with a third of all edges, coming and going."""
    rows = [("hub", f"n{i % 900}", "T") for i in range(3000)] + [(f"n{i % 900}", "hub", "T") for i in range(300)] + [(f"n{i % 900}", f"n{(i * 7 + 1) % 900}", "T") for i in range(5700)]
    return spark.createDataFrame(rows, "from_id string, to_id string, type string").repartition(4)


def test_hubs_are_split_and_joins_stay_the_same(spark, star):
    assert hubs.hub_keys(star, "from_id", 0.2) == ["hub"] and hubs.hub_keys(star, "from_id", 0.5) == [] == hubs.hub_keys(star.limit(0), "from_id", 0.2)
    nodes = spark.createDataFrame([("hub", "Hub"), *[(f"n{i}", "Node") for i in range(900)]], "id string, label string")
    pattern = [node("a", "Node"), edge("T"), node("h", "Hub"), edge("T"), node("b")]
    plain, split = match(nodes, star, pattern), match(nodes, star, pattern, split_hubs=0.1)
    shown = lambda df: sorted(map(tuple, df.select("a_id", "b_id").collect()))
    assert shown(plain) == shown(split) and len(shown(plain)) == 300 * 3000
    start = spark.createDataFrame([("n1",), ("hub",)], "id string")
    one, other = (paths.expand(start, star, 1, 2, split_hubs=s).groupBy("start", "depth").count() for s in (None, 0.1))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_no_task_reads_a_hub_alone(spark, star):
    left = spark.createDataFrame([("hub",), *[(f"n{i}",) for i in range(900)]], "k string")
    keep = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for c, v in zip(keep, ("false", "-1", "8"), strict=True):
        spark.conf.set(c, v)
    try:
        joined = hubs.hub_join(left, star, "k", "from_id", 0.2, salts=32)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        plain = [r["count"] for r in left.join(star, F.col("k") == F.col("from_id")).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)
    assert sum(sizes) == sum(plain) == 9000
    assert max(plain) > 3 * np.median(plain)
    # the plain part and the hubs' part each have their tasks
    assert max(sizes) <= 3 * np.median(sizes)


def test_near_search_is_unchanged_by_recall(spark):
    rng = np.random.default_rng(7)
    words = random_words(rng, 30)
    corpus = prints_of(spark, list(enumerate(words)))
    asked = prints_of(spark, [(i, flipped(rng, words[i], 300)) for i in range(30)])
    exact, sampled = (search.hamming_join(asked, corpus, 2, most=1000, recall=r).select("query_id", "id", "distance", "rank") for r in (1.0, 0.999999))
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, sampled.collect()))
