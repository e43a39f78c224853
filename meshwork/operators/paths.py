"""Paths in an edge table: node-simple expansion, first paths, chains and shortest paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import hamming
from ..sources.scratch import Scratch, written
from .hubs import hub_join, hub_keys

#: Paths whose confidence falls below this are not followed (fixed value).
LEAST_CONFIDENCE = 0.3


def _measured(edges: DataFrame) -> DataFrame:
    """The columns that paths carry, and no others: wide columns such as prints never travel along."""
    has = lambda c, other: F.col(c) if c in edges.columns else other
    amp = F.coalesce(has("amplification", F.lit(None)).cast("double"), has("weight", F.lit(None)).cast("double"), F.lit(1.0))
    return edges.select(
        F.col("from_id").alias("u"), F.col("to_id").alias("v"), amp.alias("e_amp"), F.coalesce(has("confidence", F.lit(1.0)).cast("double"), F.lit(1.0)).alias("e_conf"),
        F.coalesce(has("latency", F.lit(1)).cast("long"), F.lit(1)).alias("e_lat"),
    )


def _zero(starts: DataFrame) -> DataFrame:
    """The paths of no edge."""
    return starts.select(F.col("id").alias("start")).distinct().select(
        "start", F.col("start").alias("end"), F.array("start").alias("path"), F.lit(1.0).alias("amplification"), F.lit(1.0).alias("confidence"),
        F.lit(0).cast("long").alias("latency"), F.lit(0).alias("depth"),
    )


def _step(level: DataFrame, hops: DataFrame, depth: int, least_confidence: float, split_hubs: float | None = None, hubs: list | None = None) -> DataFrame:
    """The paths of a level with one more edge, to a node that they haven't visited."""
    met = hub_join(level, hops, "end", "u", split_hubs, keys=hubs) if split_hubs else level.join(hops, F.col("end") == F.col("u"))
    return (
        met.where(~F.array_contains("path", F.col("v")) & (F.col("confidence") * F.col("e_conf") >= least_confidence))
        .select(
            "start", F.col("v").alias("end"), F.concat("path", F.array("v")).alias("path"), (F.col("amplification") * F.col("e_amp")).alias("amplification"),
            (F.col("confidence") * F.col("e_conf")).alias("confidence"), (F.col("latency") + F.col("e_lat")).alias("latency"), F.lit(depth).alias("depth"),
        )
    )


def best_ahead(hops: DataFrame, ends: DataFrame | None, most: int, cut_every: int = 3) -> list[DataFrame]:
    """For 0 to most edges: (node, ahead_conf, ahead_amp), bounds of what any path of at most that many edges from node on adds.

    A backward relaxation over walks: each round takes, of each node's edges, the greatest product of confidences and of
    absolute amplifications. Paths visit no node twice and walks may, so the bounds are never too low. Walks end in ends
    (id), without these anywhere; nodes that reach none are missing. Every few rounds the lineage is cut, and rounds that
    change nothing any more are one round.
    """
    nodes = hops.select(F.explode(F.array("u", "v")).alias("id"))
    stay = (nodes if ends is None else nodes.unionByName(ends.select("id"))).distinct().select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("c"), F.lit(1.0).alias("a"))
    # parallel edges count once; an edge from each node to itself stands for walks that are shorter
    own = hops.groupBy("u", "v").agg(F.max("e_conf").alias("c"), F.max(F.abs("e_amp")).alias("a"))
    links = written(own.unionByName(stay), "links")
    goals = (nodes if ends is None else ends.select("id")).distinct()
    rounds = [goals.select(F.col("id").alias("node"), F.lit(1.0).alias("ahead_conf"), F.lit(1.0).alias("ahead_amp"))]
    seen = None
    for n in range(1, most + 1):
        met = links.join(rounds[-1], F.col("v") == F.col("node")).select(F.col("u").alias("n"), (F.col("c") * F.col("ahead_conf")).alias("p"), (F.col("a") * F.col("ahead_amp")).alias("q"))
        best = met.groupBy(F.col("n").alias("node")).agg(F.max("p").alias("ahead_conf"), F.max("q").alias("ahead_amp"))
        if n % cut_every == 0 and n < most:
            best = written(best, f"ahead{n}")
            now = best.agg(F.count("*"), F.sum("ahead_conf"), F.sum("ahead_amp")).first()
            if now == seen:
                return rounds + [best] * (most + 1 - n)
            seen = now
        rounds.append(best)
    return rounds


def expand(
    starts: DataFrame, edges: DataFrame, least: int, most: int, least_confidence: float = 0.0, until: str | None = None, above: float | None = None, ends: DataFrame | None = None,
    split_hubs: float | None = None,
) -> DataFrame:
    """(start, end, path, amplification, confidence, latency, depth) of all paths of least to most edges that visit no node twice.

    starts has a column id. Amplification and confidence are products, latency is a sum; an edge without amplification has
    its weight's, then 1. Paths below least_confidence are dropped as they fall, since products of confidences only fall.
    A path that has reached `until` goes no further. Parallel edges give a path each; cycles and self-loops end by the rule.

    With `above`, only paths that amplify by more count; with `ends` (id), only those that end there. Then partial paths are
    branches with bounds: best_ahead() says what the edges that are left can add at most, and a path that can reach no end,
    not keep the confidence or not amplify enough goes at once. So the paths that are written lead to results, as far as
    walks tell. One join a level, each level written, stopped when no path is left.

    With split_hubs, a share, the edges of nodes with that share of all edges or more are dealt by a salt, see hub_join().
    """
    hops = _measured(edges)
    bounded = above is not None or ends is not None
    if most > 3 or split_hubs:  # what makes the edges isn't done again for each level
        hops = written(hops, "hops")
    hubs = hub_keys(hops, "u", split_hubs) if split_hubs else None
    ahead = best_ahead(hops, ends, most - 1) if bounded and most else []
    # products are rounded in another order than a path's own
    up = 1 + 1e-9

    def worth(level: DataFrame, left: int) -> DataFrame:
        if not bounded:
            return level
        met = level.join(ahead[left], F.col("end") == F.col("node"))
        ok = F.col("confidence") * F.col("ahead_conf") * up >= least_confidence
        if above is not None:
            ok = ok & (F.abs("amplification") * F.col("ahead_amp") * up > above)
        return met.where(ok).select(*level.columns)

    def wanted(level: DataFrame) -> DataFrame:
        level = level if above is None else level.where(F.col("amplification") > above)
        return level if ends is None else level.join(ends.select(F.col("id").alias("end")).distinct(), "end", "left_semi").select(*level.columns)

    level = _zero(starts)
    levels = [level] if least == 0 else []
    for depth in range(1, most + 1):
        open_paths = level if until is None else level.where(F.col("end") != until)
        level = worth(_step(open_paths, hops, depth, least_confidence, split_hubs, hubs), most - depth)
        if depth < most:
            level = written(level, f"level{depth}")
            if level.isEmpty():
                break
        if depth >= least:
            levels.append(level)
    return wanted(reduce(DataFrame.unionByName, levels or [level]))


def first_paths(paths: DataFrame) -> DataFrame:
    """Of each (start, end) the path of fewest edges, ties to the least path."""
    best = F.row_number().over(Window.partitionBy("start", "end").orderBy("depth", "path", F.desc("amplification")))
    return paths.withColumn("_n", best).where("_n = 1").drop("_n")


def trace_effects(starts: DataFrame, edges: DataFrame, most: int = 10, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Every node reached from each start, by its first path that keeps the confidence: the one of fewest edges, ties to the
    least path.

    Not all paths are followed: one that isn't more confident than a shorter one to the same node, or than one of its own
    length before it, can't be part of any first path. So a level holds few rows for a start and node.
    """
    hops = written(_measured(edges), "hops")
    level = _zero(starts)
    before = Window.partitionBy("start", "end").orderBy("path", F.desc("amplification"), F.desc("confidence")).rowsBetween(Window.unboundedPreceding, -1)
    kept: list[DataFrame] = []
    for depth in range(1, most + 1):
        level = _step(level, hops, depth, least_confidence).withColumn("best", F.max("confidence").over(before))
        if kept:
            shorter = reduce(DataFrame.unionByName, kept).groupBy("start", "end").agg(F.max("confidence").alias("shorter"))
            level = level.join(shorter, ["start", "end"], "left").withColumn("best", F.greatest("best", "shorter")).drop("shorter")
        level = written(level.where(F.col("best").isNull() | (F.col("confidence") > F.col("best"))).drop("best"), f"level{depth}")
        if level.isEmpty():
            break
        kept.append(level)
    return first_paths(reduce(DataFrame.unionByName, kept or [level]))


def in_traversal_order(paths: DataFrame) -> DataFrame:
    """Shorter paths first, of one length the more amplified ones."""
    return paths.orderBy("depth", F.desc("amplification"), "path")


def most_amplified_first(paths: DataFrame) -> DataFrame:
    """The other default order: more amplified paths first, of those the shorter ones."""
    return paths.orderBy(F.desc("amplification"), "depth", "path")


def amplified(paths: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Paths that amplify by the threshold or more."""
    return paths.where(F.col("amplification") >= threshold)


def trace_chain(edges: DataFrame, source: str, target: str, most: int = 10, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """All simple paths from source to target, most confident first. Only branches that can still reach it are followed."""
    start, end = (edges.sparkSession.createDataFrame([(x,)], "id string") for x in (source, target))
    found = expand(start, edges, 1, most, least_confidence, until=target, ends=end)
    return found.orderBy(F.desc("confidence"), "depth", "path")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"from_id": F.col("to_id"), "to_id": F.col("from_id")})


def trace_root_causes(targets: DataFrame, edges: DataFrame, most: int = 10, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Every node from which a target can be reached: start is the target, end the cause, path runs from cause to target."""
    return trace_effects(targets, reversed_edges(edges), most, least_confidence).withColumn("path", F.reverse("path"))


def shortest_paths(starts: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(start, end, depth) by breadth: each node is kept once for a start, so no paths are enumerated."""
    hops = edges.select(F.col("from_id").alias("u"), F.col("to_id").alias("v")).distinct()
    seen = starts.select(F.col("id").alias("start"), F.col("id").alias("end"), F.lit(0).alias("depth")).distinct()
    front = seen
    for depth in range(1, most + 1):
        reached = front.join(hops, F.col("end") == F.col("u")).select("start", F.col("v").alias("end")).distinct()
        front = written(reached.join(seen, ["start", "end"], "left_anti").withColumn("depth", F.lit(depth)), f"front{depth}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def lightest_paths(
    starts: DataFrame, edges: DataFrame, weight: Column, targets: DataFrame | None = None, delta: float | None = None, potential: DataFrame | None = None, with_path: bool = True
) -> DataFrame:
    """(start, end, distance, path, depth): the path of least total weight from each start to every node that it reaches, ties to
    the least path; the start itself is at 0.

    weight is an expression over edges' columns and must be zero or more; edges whose weight is null are left out, of
    parallel ones the lightest counts. Distances are summed from the start on.

    Bucketed relaxation (delta-stepping): open nodes within delta of the nearest one are relaxed together over light edges,
    below delta, until none of them gets nearer; then they are settled and their heavy edges are relaxed once. A round is
    one join and one aggregation of the open nodes, written to the shared folder, so rounds grow with the number of
    buckets, greatest distance by delta, and not with nodes. delta is the mean weight unless it is given.

    With targets (id) it ends once all that can be reached are settled for all starts, and returns these only. With a
    potential (id, potential), nodes are taken in the order of distance plus potential, as A* does: it must be consistent, so
    no edge is lighter than its ends' potentials differ, nodes without one have 0, and its results are the same.

    Without with_path the result is (start, end, distance), and a potential isn't allowed: offers then are numbers, which are
    aggregated by hash before they move; those with paths are sorted as a whole.
    """
    if potential is not None and not with_path:
        raise ValueError("a potential needs paths")
    spark = edges.sparkSession
    links = edges.select(F.col("from_id").alias("u"), F.col("to_id").alias("v"), weight.cast("double").alias("w")).where("w is not null and u is not null and v is not null and u <> v")
    links = links.groupBy("u", "v").agg(F.min("w").alias("w"))
    if potential is None:
        links = links.withColumn("r", F.col("w"))
    else:
        known = potential.select(F.col("id").alias("_i"), F.col("potential").cast("double").alias("_p")).groupBy("_i").agg(F.min("_p").alias("_p"))
        of = lambda end, name: known.select(F.col("_i").alias(end), F.col("_p").alias(name))
        links = links.join(of("u", "pu"), "u", "left").join(of("v", "pv"), "v", "left")
        # reduced weights: what an edge costs beyond what it brings nearer; rounding may leave a little below zero
        reduced = F.col("w") - F.coalesce("pu", F.lit(0.0)) + F.coalesce("pv", F.lit(0.0))
        links = links.select("u", "v", "w", F.when((reduced < 0) & (reduced > -1e-9 * (1 + F.col("w"))), 0.0).otherwise(reduced).alias("r"))
    with Scratch(spark) as scratch:
        links = scratch.written(links, "links")
        seen = links.agg(F.min("r").alias("least"), F.min("w").alias("lightest"), F.avg("r").alias("mean")).first()
        if (seen["least"] or 0) < 0 or (seen["lightest"] or 0) < 0:
            raise ValueError("weights must be zero or more" if seen["lightest"] < 0 else "the potential isn't consistent: an edge is lighter than its ends' potentials differ")
        step = delta or seen["mean"] or 1.0
        light, heavy = links.where(F.col("r") < step), links.where(F.col("r") >= step)
        kept = ["key", "distance", "path"] if with_path else ["key"]

        def merged(df: DataFrame) -> DataFrame:
            """The best offer of each start and end; of equal ones the least fresh."""
            by = df.groupBy("start", "end")
            if with_path:
                return by.agg(F.min(F.struct(*kept, "fresh")).alias("b")).select("start", "end", *[f"b.{c}" for c in (*kept, "fresh")])
            both = by.agg(F.min("key").alias("key"), F.min(F.when(F.col("fresh") < 0, F.col("key"))).alias("old"))
            return both.select("start", "end", "key", F.when(F.col("old") <= F.col("key"), -1).otherwise(0).alias("fresh"))

        zero = starts.select(F.col("id").alias("start")).where("start is not null").distinct()
        open_ = zero.select("start", F.col("start").alias("end"), F.lit(0.0).alias("key"), F.lit(0.0).alias("distance"), F.array("start").alias("path"), F.lit(0).alias("fresh"))
        open_ = scratch.written(open_.select("start", "end", *kept, "fresh"), "open", keep=True)
        need = None if targets is None else zero.count() * targets.select("id").distinct().count()
        settled: list[DataFrame] = []

        def relaxed(front: DataFrame, over: DataFrame) -> DataFrame:
            met = front.join(over, F.col("end") == F.col("u"))
            grown = {"key": F.col("key") + F.col("r"), "distance": F.col("distance") + F.col("w") if with_path else None, "path": F.concat("path", F.array("v")) if with_path else None}
            return met.select("start", F.col("v").alias("end"), *[grown[c].alias(c) for c in kept], F.lit(0).alias("fresh"))

        def without_settled(df: DataFrame) -> DataFrame:
            return df.join(reduce(DataFrame.unionByName, settled).select("start", "end"), ["start", "end"], "left_anti").select(*open_.columns) if settled else df

        def wanted(parts: list[DataFrame]) -> DataFrame:
            found = reduce(DataFrame.unionByName, parts)
            return found if targets is None else found.join(targets.select(F.col("id").alias("end")).distinct(), "end", "left_semi")

        # fresh 0: got nearer since it was relaxed last; of equal offers an old one, which has been relaxed, is kept
        while (first := open_.agg(F.min("key")).first()[0]) is not None:
            until = (first // step + 1) * step
            while until <= first:  # of keys so large that a bucket is lost in rounding
                until = first * (1 + 1e-15) + step
            near = F.col("key") < until
            while not (front := open_.where(near & (F.col("fresh") == 0))).isEmpty():
                passed = open_.withColumn("fresh", F.when(near, 1).otherwise(F.col("fresh")))
                # an offer as good as what is known isn't news; offers are few once they are merged, so settled ends go after that
                all_ = passed.withColumn("fresh", -F.col("fresh")).unionByName(relaxed(front, light))
                open_ = scratch.written(without_settled(merged(all_)).withColumn("fresh", -F.col("fresh")), f"open{len(settled)}")
            done = scratch.written(open_.where(near), "settled", keep=True)
            settled.append(done)
            offers = relaxed(done, heavy)
            open_ = scratch.written(without_settled(merged(open_.where(~near).unionByName(offers))), f"open{len(settled)}")
            if targets is not None and wanted(settled).count() >= need:
                break
        found = wanted(settled or [open_])
        if not with_path:
            return found.select("start", "end", F.col("key").alias("distance"))
        return found.select("start", "end", "distance", "path", (F.size("path") - 1).alias("depth"))


def print_potential(prints: DataFrame, target: str, edges: DataFrame, weight: Column, words: str = "words") -> DataFrame:
    """(id, potential) that leads to target through the space of prints: the bits that differ from target's print, times the
    least weight of a bit that any edge has.

    Distances of prints obey the triangle inequality, so no edge is lighter than its ends' potentials differ, whatever the
    weights are. Edges whose ends have equal prints are free to weigh anything; an end without a print makes all potentials 0.
    """
    own = prints.where(F.col(words).isNotNull()).select("id", F.col(words).alias("w"))
    links = edges.select(F.col("from_id").alias("u"), F.col("to_id").alias("v"), weight.cast("double").alias("weight")).where("weight is not null and u <> v")
    ends = links.join(own.select(F.col("id").alias("u"), F.col("w").alias("a")), "u", "left").join(own.select(F.col("id").alias("v"), F.col("w").alias("b")), "v", "left")
    apart = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.try_divide(F.col("weight"), hamming(F.col("a"), F.col("b"))))
    scale = ends.agg(F.min(apart)).first()[0] or 0.0
    goal = own.where(F.col("id") == target).first()
    at = F.lit(None).cast("array<bigint>") if goal is None else F.array(*map(F.lit, goal["w"])).cast("array<bigint>")
    return own.select("id", (hamming(F.col("w"), at) * F.lit(scale if goal else 0.0)).alias("potential"))


def lightest_path(edges: DataFrame, source: str, target: str, weight: Column, potential: DataFrame | None = None, delta: float | None = None) -> DataFrame:
    """The lightest path from source to target, one row or none; with a potential it is A*."""
    start, end = (edges.sparkSession.createDataFrame([(x,)], "id string") for x in (source, target))
    return lightest_paths(start, edges, weight, end, delta, potential)


def neighbourhood(starts: DataFrame, edges: DataFrame, most: int = 3, types: list[str] | None = None) -> DataFrame:
    """(start, end, distance) of all other nodes within `most` edges of each start, whichever way edges point, of the given types;
    each node once, at its least distance."""
    own = edges if types is None else edges.where(F.col("type").isin(*types))
    both = own.select("from_id", "to_id").unionByName(own.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    return shortest_paths(starts, both, most).where("depth > 0").withColumnRenamed("depth", "distance")


def path_length(path: str = "path") -> Column:
    return F.size(path) - 1


def degrees(edges: DataFrame) -> DataFrame:
    """(id, fan_out, fan_in) of every node with an edge."""
    ends = edges.select(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy("id").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))
