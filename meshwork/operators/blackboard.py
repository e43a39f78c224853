"""The agents' blackboard: typed nodes and edges of the graph, and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprints import sha_chain
from ..schema import GATES, THINKING_STYLES

# Rules of the blackboard (fixed values). A route for the words of a task, first match wins; the rest goes to the developer.
ROUTES = [
    (("excavate", "find"), "archaeologist"),
    (("evaluate", "priority"), "product_sage"),
    (("learn", "capture"), "meta_learner"),
    (("review",), "reviewer"),
]
DANGEROUS = {
    "acts_as_": "Meta-programming magic - trace carefully",
    "method_missing": "Dynamic method handling - unpredictable",
    "eval(": "Code execution - security risk",
    "send(": "Dynamic dispatch - trace all paths",
}


# Code smells and the bounds beyond which they hold (fixed values).
ANTIPATTERNS = {
    "GOD_CLASS": "method_count > 20",
    "LONG_METHOD": "lines > 50",
    "FEATURE_ENVY": "external_calls > internal_calls",
    "DATA_CLUMP": "repeated_param_groups > 2",
    "PRIMITIVE_OBSESSION": "primitive_ratio > 0.8",
    "SHOTGUN_SURGERY": "change_fan_out > 5",
    "DIVERGENT_CHANGE": "change_reasons > 3",
    "PARALLEL_INHERITANCE": "mirror_hierarchies > 0",
    "LAZY_CLASS": "method_count < 3",
    "SPECULATIVE_GENERALITY": "unused_abstractions > 0",
}
# Targets of the compliance ratios: each is to be above (fixed values).
COMPLIANCE = {"spawn_rate": 0.3, "handover_completeness": 0.95, "context_overflow_prevention": 0.99}


def active_blockers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocker nodes that no RESOLVES edge points at."""
    solved = edges.where(F.col("type") == "RESOLVES").select(F.col("to_id").alias("id"))
    return nodes.where(F.col("label") == "Blocker").join(solved, "id", "left_anti")


def messages(nodes: DataFrame, kind: str | None = None, sender: str | None = None, limit: int | None = None) -> DataFrame:
    """Message nodes, newest first, by kind and by the sender in their properties."""
    found = nodes.where(F.col("label").startswith("Message:") if kind is None else F.col("label") == f"Message:{kind}")
    if sender is not None:
        found = found.where(F.get_json_object("properties", "$.from_agent") == sender)
    found = found.orderBy(F.desc("created_at"), "id")
    return found if limit is None else found.limit(limit)


def note(kind: str, agent: str, content: Column, at: Column, **properties: Column) -> list[Column]:
    """The node columns of a thought, decision, blocker or resolution; id is kind:agent:time."""
    own = F.to_json(F.struct(F.lit(agent).alias("agent"), *[c.alias(n) for n, c in properties.items()]))
    key = F.concat_ws(":", F.lit(kind.lower()), F.lit(agent), F.date_format(at, "yyyyMMddHHmmssSSSSSS"))
    return [key.alias("id"), F.lit(kind).alias("label"), content.alias("content"), own.alias("properties"), at.cast("timestamp_ntz").alias("created_at")]


def decision(agent: str, content: Column, gate: str, at: Column) -> list[Column]:
    if gate not in GATES:
        raise ValueError(f"gate {gate!r} is none of {', '.join(GATES)}")
    return note("Decision", agent, content, at, gate=F.lit(gate))


def is_breakthrough(satisfaction: Column, effort: Column) -> Column:
    return (satisfaction > 0.7) & (effort > 0.5)


def learning_qidx(satisfaction: Column) -> Column:
    return F.floor(255 * satisfaction).cast("smallint")


def learning_summary(moments: DataFrame, until: object, hours: float) -> DataFrame:
    """Count, mean satisfaction, breakthroughs and velocity of the hours before `until`."""
    own = moments.where((F.col("created_at") > F.lit(until).cast("timestamp_ntz") - F.expr(f"interval {int(hours * 3600)} seconds")) & (F.col("created_at") <= F.lit(until)))
    return own.agg(
        F.count("*").alias("moments"), F.avg("satisfaction").alias("mean_satisfaction"), F.count_if("is_breakthrough").alias("breakthroughs"),
        (F.count("*") / F.lit(float(hours))).alias("velocity"),
    )


def route_task(task: Column, agents: list[str] | None = None) -> Column:
    """The agent for a task by its words; the orchestrator's where the agent isn't one of those there are (None: all are)."""
    text, out = F.lower(task), F.lit("developer")
    for words, agent in reversed(ROUTES):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), agent).otherwise(out)
    return out if agents is None else F.when(out.isin(agents), out).otherwise("orchestrator")


def spawn_rule(context_percent: Column, domain: Column, needs_ux: Column, failed: Column) -> Column:
    """The agent to spawn, null if there is no reason: the first rule that holds decides, null counts as not holding."""
    return (
        F.when(context_percent > 60, "continuation_agent").when(domain == "rails", "archaeologist").when(needs_ux, "product_sage")
        .when(failed >= 3, "fresh_perspective")
    )


def dangerous(text: Column) -> Column:
    """The dangerous patterns that a text holds, in their order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in DANGEROUS]))


def danger_warnings(text: Column) -> Column:
    """A line with its reason for each dangerous pattern."""
    return F.transform(dangerous(text), lambda p: F.concat(p, F.lit(": "), F.element_at(F.create_map(*[F.lit(x) for kv in DANGEROUS.items() for x in kv]), p)))


def merged_concepts(concepts: DataFrame) -> DataFrame:
    """Concepts of one label as one: evidence joined, confidence averaged."""
    return concepts.groupBy("label").agg(F.flatten(F.collect_list("evidence")).alias("evidence"), F.avg("confidence").alias("confidence"))


def handover_markdown(row: dict) -> str:
    parts = [f"# Handover: {row['from_agent']} to {row['to_agent']}", f"**Task:** {row.get('task') or '-'}", row.get("context") or ""]
    for title, key in (("Files", "files_modified"), ("Blockers", "blockers"), ("Next steps", "next_steps"), ("Related", "resonance_hits")):
        if row.get(key):
            parts.append("\n".join([f"## {title}", *(f"- {x}" for x in row[key])]))
    return "\n\n".join(p for p in parts if p)


def is_positive(valence: Column) -> Column:
    return valence > 0


def is_intense(intensity: Column) -> Column:
    return intensity > 0.7


def is_resolved(resolved_at: Column) -> Column:
    return resolved_at.isNotNull()


def default_style(qidx: Column) -> Column:
    """The thinking style of a node without one: the dimension qidx mod 7 alone."""
    n = len(THINKING_STYLES)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == F.pmod(qidx.cast("int"), F.lit(n)), 1.0).otherwise(0.0).cast("float"))


def antipatterns(df: DataFrame, name: str = "smells") -> DataFrame:
    """df with the names of the code smells that its measures show; a missing or null measure shows none."""
    shown = []
    for smell, rule in ANTIPATTERNS.items():
        needs = [w for w in rule.split() if w.isidentifier()]
        if all(c in df.columns for c in needs):
            shown.append(F.when(F.expr(rule), F.lit(smell)))
    return df.withColumn(name, F.array_compact(F.array(*shown)) if shown else F.array().cast("array<string>"))


def compliance(counts: DataFrame) -> DataFrame:
    """(metric, value, target, met) from one row of counts; a ratio over nothing is null and not met."""
    ratio = {
        "spawn_rate": F.col("agent_spawns") / F.nullif("significant_tasks", F.lit(0)),
        "handover_completeness": F.col("complete_handovers") / F.nullif("total_handovers", F.lit(0)),
        "context_overflow_prevention": 1 - F.col("overflows") / F.nullif("sessions", F.lit(0)),
    }
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), ratio[m].alias("value"), F.lit(t).alias("target")) for m, t in COMPLIANCE.items()])
    each = counts.select(F.explode(rows).alias("r")).select("r.*")
    return each.withColumn("met", F.coalesce(F.col("value") > F.col("target"), F.lit(False)))


def agent_state_print(agent_id: Column, task: Column, context: Column) -> Column:
    """The print of an agent's state; context is its JSON text, an agent without a task has the task "None"."""
    return sha_chain(F.concat_ws(":", agent_id, F.coalesce(task, F.lit("None")), context))


def edge_key(from_id: Column, kind: Column, to_id: Column) -> Column:
    """The id that an edge has in transfer objects, which isn't the one of stored edges."""
    return F.concat(from_id, F.lit("--"), kind, F.lit("-->"), to_id)
