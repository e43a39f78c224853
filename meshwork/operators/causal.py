"""Causal graphs: amplification ("butterfly") and impact analysis, reinforcement and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .paths import expand, shortest_paths, trace_effects

#: Defaults of the edge shorthands: type, strength, amplification (fixed values).
SHORTHANDS = {"causes": ("CAUSES", 0.5, 1.0), "amplifies": ("AMPLIFIES", 0.7, 2.0), "enables": ("ENABLES", 0.3, 1.0), "triggers": ("TRIGGERS", 0.8, 1.5)}
CONFIDENCE, LATENCY = 0.8, 1
BUTTERFLY, CORRELATED = 5.0, 0.3
CAUSAL_TYPES = ("CAUSES", "AMPLIFIES")
IMPACT_TYPES = ("CAUSES", "AMPLIFIES", "ENABLES")


def causal_edge(kind: str, source: str, target: str, amplification: float | None = None, strength: float | None = None) -> list[dict]:
    """An edge row of a shorthand; "correlates" is two CORRELATES edges, one each way."""
    if kind == "correlates":
        ends, (name, s, a) = [(source, target), (target, source)], ("CORRELATES", 0.5, 1.0)
    else:
        ends, (name, s, a) = [(source, target)], SHORTHANDS[kind]
    own = {"strength": s if strength is None else strength, "amplification": a if amplification is None else amplification, "confidence": CONFIDENCE, "latency": LATENCY}
    return [{"from_id": u, "to_id": v, "type": name, **own} for u, v in ends]


def reinforced(observed: DataFrame, order: str) -> DataFrame:
    """Repeated edges of the same ends as one: the first one's attributes, observations counted, confidence up 0.1 each, to 1."""
    first = {c: F.min_by(F.struct(c), order)[c].alias(c) for c in observed.columns if c not in ("from_id", "to_id", "confidence", order)}
    base = F.min_by(F.struct("confidence"), order)["confidence"]
    n = F.count("*")
    return observed.groupBy("from_id", "to_id").agg(
        *first.values(), F.least(F.lit(1.0), F.coalesce(base, F.lit(CONFIDENCE)) + 0.1 * (n - 1)).alias("confidence"), n.alias("observations")
    )


def detect_butterflies(starts: DataFrame, edges: DataFrame, criticality: DataFrame, magnitude: float = 1.0, ratio: float = BUTTERFLY, most: int = 10) -> DataFrame:
    """Effects whose first path amplifies by `ratio` or more, with criticality = ratio * the target's criticality * confidence.

    criticality has (id, criticality); nodes without have 0.5. starts of several rows are traced in one job.
    """
    found = trace_effects(starts, edges, most).where(F.col("amplification") >= ratio)
    own = criticality.select(F.col("id").alias("end"), F.col("criticality").alias("_c"))
    scored = found.join(own, "end", "left").withColumn("criticality", F.col("amplification") * F.coalesce("_c", F.lit(0.5)) * F.col("confidence"))
    return scored.withColumn("final_magnitude", F.lit(magnitude) * F.col("amplification")).drop("_c")


def find_all_butterflies(nodes: DataFrame, edges: DataFrame, **how: float) -> DataFrame:
    return detect_butterflies(nodes.select("id"), edges, nodes, **how)


def butterfly_paths(starts: DataFrame, edges: DataFrame, threshold: float = BUTTERFLY, most: int = 10) -> DataFrame:
    """All simple causal paths, not only first ones, that amplify by more than the threshold. Paths that can't any more, however
    they go on, are cut."""
    return expand(starts, edges.where(F.col("type").isin(*CAUSAL_TYPES)), 1, most, above=threshold)


def impact_totals(starts: DataFrame, edges: DataFrame, most: int = 10, threshold: float = BUTTERFLY) -> DataFrame:
    """(start, reach, butterflies, max_amplification) over causal and enabling paths of at most `most` edges.

    What is reached is found by breadth, a row for each node. Butterflies are paths of causal types that amplify by more
    than the threshold, by branch and bound; max_amplification is their greatest, 1 without any. A start without effects has zeros.
    """
    reached = shortest_paths(starts, edges.where(F.col("type").isin(*IMPACT_TYPES)), most).where("depth > 0").groupBy("start").agg(F.count("*").alias("reach"))
    found = butterfly_paths(starts, edges, threshold, most).groupBy("start").agg(F.count("*").alias("butterflies"), F.max("amplification").alias("max_amplification"))
    own = starts.select(F.col("id").alias("start")).distinct()
    return own.join(reached, "start", "left").join(found, "start", "left").fillna({"reach": 0, "butterflies": 0, "max_amplification": 1.0})


def analyze_impact(starts: DataFrame, edges: DataFrame, criticality: DataFrame, most: int = 10) -> DataFrame:
    """A row for each start: direct and indirect effects, reach, depth, greatest amplification, butterflies, critical paths.

    A path is critical if it amplifies by more than 2 and amplification times the target's criticality is over 1; the five
    that amplify most are listed. A start without effects has zeros and amplification 1.
    """
    own = criticality.select(F.col("id").alias("end"), F.col("criticality").alias("_c"))
    effects = trace_effects(starts, edges, most).join(own, "end", "left").withColumn("_c", F.coalesce("_c", F.lit(0.5)))
    critical = (F.col("amplification") > 2) & (F.col("amplification") * F.col("_c") > 1)
    rank = F.row_number().over(Window.partitionBy("start", critical).orderBy(F.desc("amplification"), "path"))
    ranked = effects.withColumn("_critical", critical & (rank <= 5))
    worst = F.transform(F.array_sort(F.collect_list(F.when(F.col("_critical"), F.struct((-F.col("amplification")).alias("a"), "path")))), lambda x: x["path"])
    summed = ranked.groupBy("start").agg(
        F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("indirect"), F.count("*").alias("reach"),
        F.max("depth").alias("max_depth"), F.max("amplification").alias("max_amplification"), F.count_if(F.col("amplification") >= BUTTERFLY).alias("butterflies"),
        worst.alias("critical_paths"),
    )
    zeros = {"direct": 0, "indirect": 0, "reach": 0, "max_depth": 0, "max_amplification": 1.0, "butterflies": 0}
    all_starts = starts.select(F.col("id").alias("start")).distinct().join(summed, "start", "left").fillna(zeros)
    return all_starts.withColumn("critical_paths", F.coalesce("critical_paths", F.array().cast("array<array<string>>")))


def find_correlations(pairs: DataFrame, least: float = CORRELATED) -> DataFrame:
    """(changed, affected, observations, strength): co-occurrences over all of changed's occurrences on either side, above least."""
    return correlations_of(pairs.groupBy("changed", "affected").agg(F.count("*").alias("observations")), least)


def correlations_of(counts: DataFrame, least: float = CORRELATED) -> DataFrame:
    """find_correlations() from counts of pairs (changed, affected, observations)."""
    sides = counts.select(F.col("changed").alias("changed_"), "observations").unionByName(counts.select(F.col("affected").alias("changed_"), "observations"))
    total = sides.groupBy("changed_").agg(F.sum("observations").alias("n"))
    scored = counts.join(total, F.col("changed") == F.col("changed_")).withColumn("strength", F.col("observations") / F.col("n"))
    return scored.where(F.col("strength") > least).select("changed", "affected", "observations", "strength")


def learn_edges(pairs: DataFrame) -> DataFrame:
    """Correlations as CAUSES edges."""
    return edges_of(find_correlations(pairs))


def edges_of(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("changed").alias("from_id"), F.col("affected").alias("to_id"), F.lit("CAUSES").alias("type"), "strength", F.lit(1.0).alias("amplification"),
        F.lit(CONFIDENCE).alias("confidence"), F.lit(LATENCY).alias("latency"), "observations",
    )
