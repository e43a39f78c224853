"""Bounded and weighted paths, near prints, packed counters and the vector index against brute force."""

import heapq
import itertools
import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.functions import bits
from meshwork.operators import causal, paths, search, vector_index
from meshwork.operators.patterns import edge, match, node
from meshwork.operators.vector_index import Coder, VectorIndex, cells_for

EDGES = "from_id string, to_id string, type string, amplification double, confidence double, latency long"


def start(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def random_graph(seed, n, m):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(["CAUSES", "AMPLIFIES", "ENABLES"]), rng.choice([0.5, 1.0, 2.0, 3.0, -2.0, None]), round(rng.uniform(0.4, 1), 2), rng.randrange(1, 9)) for _ in range(m)]


def simple_paths(rows, source, most, until=None):
    """(path, amplification, confidence) of all simple paths from source."""
    out, front = [], [((source,), 1.0, 1.0)]
    for _ in range(most):
        front = [((*p, v), a * (1.0 if amp is None else amp), c * conf) for p, a, c in front if p[-1] != until for u, v, _, amp, conf, _ in rows if u == p[-1] and v not in p]
        out += front
    return out


def test_bounded_paths_are_all_paths_that_pass(spark):
    for seed in range(1):
        rows = random_graph(seed, 9, 26)
        edges = spark.createDataFrame(rows, EDGES)
        every = simple_paths(rows, "n0", 6)
        shown = lambda df: sorted((tuple(r.path), round(r.amplification, 9)) for r in df.collect())
        plain = lambda found: sorted((p, round(a, 9)) for p, a, _ in found)
        assert shown(paths.expand(start(spark, "n0"), edges, 1, 6)) == plain(every)
        assert shown(paths.expand(start(spark, "n0"), edges, 1, 6, above=2.5)) == plain(x for x in every if x[1] > 2.5)
        ends = start(spark, "n3", "n5", "n0", "nowhere")
        assert shown(paths.expand(start(spark, "n0"), edges, 2, 6, 0.2, ends=ends)) == plain(x for x in every if x[0][-1] in ("n3", "n5") and x[2] >= 0.2 and len(x[0]) > 2)
        assert shown(paths.expand(start(spark, "n0"), edges, 0, 6, above=0.9, ends=ends)) == plain([*(x for x in every if x[0][-1] in ("n3", "n5") and x[1] > 0.9), (("n0",), 1.0, 1.0)])
        chain = simple_paths(rows, "n0", 6, until="n4")
        assert shown(paths.trace_chain(edges, "n0", "n4", 6)) == plain(x for x in chain if x[0][-1] == "n4" and x[2] >= 0.3)
        causes = [r for r in rows if r[2] != "ENABLES"]
        strong = [x for x in simple_paths(causes, "n0", 6) if x[1] > 2]
        assert shown(causal.butterfly_paths(start(spark, "n0"), edges, 2.0, 6)) == plain(strong)
        totals = causal.impact_totals(start(spark, "n0", "alone"), edges, 6, 2.0).orderBy("start").collect()
        assert tuple(totals[0]) == ("alone", 0, 0, 1.0)
        assert (totals[1].reach, totals[1].butterflies) == (len({p[-1] for p, _, _ in every}), len(strong)) and totals[1].max_amplification == pytest.approx(max((x[1] for x in strong), default=1.0))
    assert paths.trace_chain(edges, "n0", "n0").count() == 0 and paths.expand(start(spark, "alone"), edges, 1, 5, above=1.0).count() == 0


@pytest.fixture(scope="module")
def layers(spark):
    """Ten layers of ten nodes, each linked to all of the next: 10**9 paths from a node of the first to the last layer."""
    rng = random.Random(1)
    rows = [(f"{k}_{i}", f"{k + 1}_{j}", "CAUSES", round(rng.uniform(0.9, 1.5), 3), round(rng.uniform(0.3, 0.99), 3), 1) for k in range(9) for i in range(10) for j in range(10)]
    return rows, spark.createDataFrame(rows, EDGES).repartition(2)


def counting(monkeypatch):
    written, rows = paths.written, []

    def kept(df, name):
        out = written(df, name)
        if name.startswith("level"):
            rows.append(out.count())
        return out

    monkeypatch.setattr(paths, "written", kept)
    return rows


def test_branches_that_lead_nowhere_are_not_followed(spark, layers, monkeypatch):
    rows, edges = layers
    best = {"9_0": 1.0}
    for k in range(8, -1, -1):
        for i in range(10):
            best[f"{k}_{i}"] = max(c * best.get(v, 0) for u, v, _, _, c, _ in rows if u == f"{k}_{i}")
    counts = counting(monkeypatch)
    found = paths.trace_chain(edges, "0_0", "9_0", 9, best["0_0"] * 0.7).count()
    assert found > 50 and sum(counts) <= 3 * found
    amp = {f"9_{i}": 1.0 for i in range(10)}
    for k in range(8, -1, -1):
        for i in range(10):
            amp[f"{k}_{i}"] = max(a * amp[v] for u, v, _, a, _, _ in rows if u == f"{k}_{i}")
    counts.clear()
    found = causal.butterfly_paths(start(spark, "0_0"), edges, amp["0_0"] * 0.86, 10).count()
    assert found > 50 and sum(counts) <= 3 * found


def test_long_stretches_of_patterns_to_chosen_nodes(spark, layers):
    _, edges = layers
    nodes = spark.createDataFrame([(f"{k}_{i}", "Last" if k == 4 and i == 3 else "Node") for k in range(10) for i in range(10)], "id string, label string")
    assert match(nodes, edges, [node("a", id="0_0"), edge("CAUSES", hops=(1, 4)), node("b", "Last")]).count() == 1000


# weighted paths


def dijkstra(rows, source):
    """{node: (distance, path)}, ties to the least path."""
    out, queue = {}, [(0.0, [source])]
    while queue:
        d, path = heapq.heappop(queue)
        if path[-1] not in out:
            out[path[-1]] = d, path
            for u, v, w in rows:
                if u == path[-1] and v not in out and w is not None:
                    heapq.heappush(queue, (d + w, [*path, v]))
    return out


WEIGHTED = "from_id string, to_id string, w double"


def test_lightest_paths(spark):
    rng = random.Random(2)
    for weights, delta in ((lambda: float(rng.randrange(0, 4)), None), (lambda: rng.choice([0.0, 1.0, 50.0, rng.random(), None]), 1000.0)):
        rows = [(f"n{rng.randrange(16)}", f"n{rng.randrange(16)}", weights()) for _ in range(60)]
        found = paths.lightest_paths(start(spark, "n0", "n1", "gone"), spark.createDataFrame(rows, WEIGHTED), F.col("w"), delta=delta).collect()
        for source in ("n0", "n1", "gone"):
            want = dijkstra(rows, source)
            got = {r.end: (r.distance, r.path) for r in found if r.start == source}
            assert set(got) == set(want)
            for end, (d, path) in want.items():
                assert got[end][0] == pytest.approx(d) and (got[end][1] == path or d != int(d)) and len(got[end][1]) >= 1
    edges = spark.createDataFrame(rows, WEIGHTED)
    assert paths.lightest_path(edges, "n0", "nowhere", F.col("w")).count() == 0
    assert [(r.end, r.depth) for r in paths.lightest_path(edges, "n0", "n0", F.col("w")).collect()] == [("n0", 0)]
    with pytest.raises(ValueError):
        paths.lightest_paths(start(spark, "n0"), edges, -F.col("w"))
    assert paths.lightest_paths(start(spark), edges, F.col("w")).count() == 0


def test_rounds_follow_buckets_not_nodes(spark, monkeypatch):
    chain = [(f"{i:03}", f"{i + 1:03}", 1.0) for i in range(60)] + [(f"{i:03}", f"{i + 20:03}", 1.5) for i in range(0, 40, 20)]
    names = []
    written = paths.Scratch.written
    monkeypatch.setattr(paths.Scratch, "written", lambda self, df, name, keep=False: names.append(name) or written(self, df, name, keep))
    edges = spark.createDataFrame(chain, WEIGHTED).repartition(2)
    found = paths.lightest_path(edges, "000", "040", F.col("w"), delta=100.0).first()
    assert (found.distance, found.path) == (3.0, ["000", "020", "040"]) and names.count("settled") == 1
    ladder = [(f"{i % 50}_{i // 50}", f"{j}_{i // 50 + 1}", float(1 + (i * j) % 3)) for i in range(150) for j in range(50)]  # 200 nodes in four layers
    names.clear()
    assert paths.lightest_paths(start(spark, "0_0"), spark.createDataFrame(ladder, WEIGHTED).repartition(2), F.col("w"), delta=2.0).count() == 151
    assert names.count("settled") <= 5 and len(names) <= 20


def test_a_star_settles_less_and_finds_the_same(spark):
    n, rng = 12, random.Random(5)
    at = lambda x, y: f"{x:02}_{y:02}"
    # prints of a grid: the first x and y bits of two stretches, so bits apart are steps apart
    words = {}
    for x, y in itertools.product(range(n), repeat=2):
        own = [0] * 157
        own[0], own[1] = (1 << x) - 1, (1 << y) - 1
        words[at(x, y)] = own
    prints = spark.createDataFrame(list(words.items()), "id string, words array<bigint>")
    rows = [(at(x, y), at(x + a, y + b), 1.0 + rng.choice([0, 0, 1]) * 0.5) for x, y in itertools.product(range(n), repeat=2) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= x + a < n and 0 <= y + b < n]
    edges = spark.createDataFrame(rows, WEIGHTED).repartition(2)
    potential = paths.print_potential(prints, at(6, 6), edges, F.col("w"))
    assert {r.id: r.potential for r in potential.collect()}[at(0, 0)] == 12.0
    found = paths.lightest_path(edges, at(0, 0), at(6, 6), F.col("w"), potential, delta=0.5).first()
    assert found.distance == pytest.approx(dijkstra(rows, at(0, 0))[at(6, 6)][0])
    wrong = potential.withColumn("potential", F.col("potential") * 3)
    with pytest.raises(ValueError):
        paths.lightest_path(edges, at(0, 0), at(6, 6), F.col("w"), wrong)


# prints


def prints_of(spark, rows):
    return spark.createDataFrame([(i, None if w is None else w.view(np.int64).tolist()) for i, w in rows], "id long, words array<bigint>")


def random_words(rng, n):
    w = rng.integers(0, 1 << 63, (n, 157), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (n, 157), dtype=np.uint64)
    w[:, 156] &= np.uint64(0xFFFF)
    return w


def flipped(rng, words, n):
    held = np.unpackbits(words.view(np.uint8), bitorder="little")
    held[rng.choice(10_000, n, replace=False)] ^= 1
    return np.packbits(held, bitorder="little").view(np.uint64)


def test_near_pairs_recall_and_work(spark):
    rng = np.random.default_rng(3)
    base = random_words(rng, 700)
    planted = [(i, flipped(rng, base[i], 2000)) for i in range(400)] + [(1000 + i, flipped(rng, base[i], int(rng.integers(0, 2000)))) for i in range(300)]
    corpus = prints_of(spark, [*enumerate(base), (5000, None)]).repartition(3)
    asked = prints_of(spark, [*planted, (6000, None), (6001, flipped(rng, base[0], 2001))]).repartition(3)
    got = {(r.query_id, r.id): r.distance for r in search.near_pairs(asked, corpus, 2000, 0.995).collect()}
    want = {(q, q % 1000) for q, _ in planted}
    assert set(got) <= want and len(got) >= 0.99 * len(want) and all(got[q, q] == 2000 for q in range(400) if (q, q) in got)
    at_bound = sum((q, q) in got for q in range(400))
    assert at_bound >= 0.985 * 400
    size, tables = search.sampling(700, 2000, 0.995)
    keys = lambda df: search.sampled_keys(df.where("words is not null").select(F.col("id").cast("string").cast("binary").alias("print"), bits.to_binary(F.col("words")).alias("w")), size, tables)
    met = keys(asked).withColumnRenamed("print", "a").join(keys(corpus), ["table_no", "key"]).select("a", "print").distinct().count()
    assert met - len(want) < 0.01 * 700 * 700
    assert search.sampling(10**9, 2000, 0.99)[0] == 30 and search.sampling(5, 0, 0.99)[1] == 1
    for wrong in (2001, -1):
        with pytest.raises(ValueError):
            search.near_pairs(asked, corpus, wrong)


def test_near_pairs_of_copies(spark):
    rng = np.random.default_rng(4)
    one, other = random_words(rng, 2)
    corpus = prints_of(spark, [(i, one) for i in range(3000)] + [(9000, other)]).repartition(4)
    asked = prints_of(spark, [(1, one), (2, flipped(rng, one, 5)), (3, other), (4, one)])
    found = search.hamming_join(asked, corpus, 3, most=100, recall=0.999).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.distance) for r in found] == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (2, 0, 5), (2, 1, 5), (2, 2, 5), (3, 9000, 0), (4, 0, 0), (4, 1, 0), (4, 2, 0)]
    assert search.near_pairs(asked, corpus, 100, 0.999).count() == 3 * 3000 + 1
    exact = search.within(asked, corpus, 4900)
    assert exact.count() == search.hamming_join(asked, corpus, 1 << 20, most=4900).count()
    assert search.near_pairs(asked.limit(0), corpus, 100).count() == 0 == search.near_pairs(asked, corpus.limit(0), 100).count()


def test_packed_counters(spark):
    rng = np.random.default_rng(5)
    words = random_words(rng, 60)
    table = prints_of(spark, [*enumerate(words), (99, None)]).withColumn("g", F.when(F.col("id") < 1, "one").when(F.col("id") < 21, "even").otherwise("odd"))
    held = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    groups = {"one": held[:1], "even": held[1:21], "odd": held[21:]}
    for r in bits.bundled(table, "words", "g").collect():
        own = groups[r.g]
        assert np.array_equal(np.unpackbits(np.array(r.words, np.int64).view(np.uint8), bitorder="little"), (2 * own.sum(0, dtype=int) > len(own)).astype(np.uint8))
    for r in search.cohesion(table, "g").collect():
        own = groups[r.g].astype(int)
        pairs = [1 - np.abs(a - b).sum() / 10_000 for a, b in itertools.combinations(own, 2)]
        assert r.cohesion == pytest.approx(np.mean(pairs) if pairs else 1.0)
    plan = search.cohesion(table, "g")._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode" in plan and plan.count("Generate") == 1 and "Python" not in plan
    same = prints_of(spark, [(i, words[0]) for i in range(2000)])
    assert bits.bundled(same, "words").first().words == words[0].view(np.int64).tolist()


# the vector index


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    path = f"file://{tmp_path_factory.mktemp('index')}/ivf"
    return rows, VectorIndex.build(rows, path, "vec_id", posted=4)


def brute(rows, queries, k):
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    ids = np.array([r.vec_id for r in rows])
    out = {}
    for q in queries:
        d = np.sqrt(((x - np.array(q.embedding, dtype=np.float64)) ** 2).sum(1))
        out[q.vec_id] = ids[np.lexsort((ids, d))[:k]].tolist()
    return out


def test_recall_and_files_of_the_index(spark, index):
    rows, ivf = index
    asked = rows.where("vec_id % 50 = 7")
    want = brute(rows.collect(), asked.collect(), 20)
    probed = max(1, len(ivf.sizes) // 8)
    got = {}
    for r in ivf.search(asked, 20, probed, 10, "vec_id").collect():
        got.setdefault(r.query_id, []).append(r.id)
    recall = np.mean([len(set(want[q]) & set(got[q])) / 20 for q in want])
    assert recall >= 0.9, recall
    everything = ivf.postings()
    n_files = len(everything.inputFiles())
    for q in asked.limit(5).collect():
        own = asked.where(F.col("vec_id") == q.vec_id)
        cells = sorted(ivf.nearest_cells(np.array([q.embedding]), probed)[0].tolist())
        found = ivf.search(own, 20, probed, 10, "vec_id")
        read = {f for f in found.inputFiles() if "/postings/" in f}
        assert len(read) < 0.15 * n_files and read == set(ivf.postings(cells).inputFiles())
    assert everything.count() == 4 * rows.count() and everything.select("id").distinct().count() == rows.count()


def test_all_cells_are_exact_and_it_is_reopened(spark, index):
    rows, ivf = index
    again = VectorIndex(spark, ivf.path)
    asked = rows.where("vec_id % 400 = 3")
    got = {}
    for r in again.search(asked, 5, 10**6, None, "vec_id").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == brute(rows.collect(), asked.collect(), 5)


def test_awkward_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((80, 6)))] + [(100 + i, [1.0] * 6) for i in range(150)] + [(500, None), (501, [1.0]), (502, [math.nan] * 6), (503, [math.inf] * 6), (None, [0.0] * 6)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>").withColumn("cell", F.lit("x"))
    ivf = VectorIndex.build(table, f"file://{tmp_path}/a", n_cells=7)
    assert sum(ivf.sizes.values()) == 230 and ivf.coder.pieces == 6
    asked = table.where("id in (3, 100, 500, 501)")
    got = ivf.search(asked, 4, 7, None).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got][4:] == [(100, 100), (100, 101), (100, 102), (100, 103)] and got[0].id == 3
    assert [r.id for r in ivf.search(asked, 4, 7, 3).where("query_id = 3").orderBy("rank").collect()][0] == 3
    assert ivf.search(asked.limit(0), 4, 7).count() == 0
    with pytest.raises(ValueError):
        VectorIndex.build(table.where("id = 500"), f"file://{tmp_path}/b")
    assert cells_for(5, 64) == 1 and cells_for(2000, 64) == 250 and cells_for(10**12, 1024) == (64 << 20) // 8192
    assert isinstance(ivf.coder, Coder)


def test_exact_search_is_products_of_matrices(spark, index, monkeypatch):
    rows, ivf = index
    plan = ivf.search(rows.where("vec_id % 400 = 3"), 5, 10**6, None, "vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan
    # copies of a vector, an id with two vectors, some of the cells
    rng = np.random.default_rng(3)
    own = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 6)))] + [(100 + i, [1.0] * 6) for i in range(90)] + [(7, [1.0] * 6)]
    table = spark.createDataFrame(own, "id long, embedding array<double>")
    ivf = VectorIndex.build(table, f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/a", n_cells=7, posted=2)
    asked = spark.createDataFrame([(1, [1.0] * 6), (2, [0.5] * 6), (3, [math.nan] * 6), (4, None)], "id long, embedding array<double>")
    got = {}
    for r in ivf.search(asked, 25, 7, None).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, pytest.approx(r.score)))
    for q, v in ((1, 1.0), (2, 0.5)):
        least = {}
        for i, x in own:
            d = float(np.linalg.norm(np.array(x, np.float32).astype(float) - v))
            least[i] = min(d, least.get(i, d))
        assert [i for i, _ in got[q]] == [i for i, d in sorted(least.items(), key=lambda p: (round(p[1], 9), p[0]))[:25]]
    assert set(got) == {1, 2}
    few = ivf.search(asked.where("id = 2"), 5, 2, None).orderBy("rank").collect()
    cells = set(ivf.nearest_cells(np.full((1, 6), 0.5), 2)[0].tolist())
    met = {r.id: float(np.linalg.norm(np.array(r.vector) - 0.5)) for r in ivf.postings(sorted(cells)).collect() if r.id != 7}
    assert [r.id for r in few if r.id != 7] == [i for i, d in sorted(met.items(), key=lambda p: (round(p[1], 9), p[0]))][: len([r for r in few if r.id != 7])]


def test_distances_to_cells_are_held_in_slices(monkeypatch):
    held = []
    squares = vector_index.squares
    monkeypatch.setattr(vector_index, "squares", lambda x, c: held.append(len(x) * len(c)) or squares(x, c))
    rng = np.random.default_rng(4)
    x, centroids = rng.integers(0, 3, (3000, 4)).astype(float), rng.integers(0, 3, (2000, 4)).astype(float)
    coder = Coder(centroids, np.zeros((1, 1, 4)))
    want = np.argsort(squares(x[:50], centroids), axis=1, kind="stable")
    assert np.array_equal(coder.cells_of(x, 4)[:50], want[:, :4]) and np.array_equal(coder.cells_of(x[:50], 300), want[:, :300])
    assert len(held) > 2 and max(held) <= 1 << 20
