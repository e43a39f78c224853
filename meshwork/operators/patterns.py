"""Graph patterns as DataFrame joins.

A pattern alternates nodes and edges: match(nodes, edges, [node("c", "Customer"), edge("PLACED"), node("o", "Order")]).
Conditions and returned columns are ordinary Column expressions over names like "c_id" or "o_label"; labels, types and property
values are literals, never text that is put into a query, so names such as Order or Limit are harmless.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hubs import hub_join, hub_keys
from .paths import expand


@dataclass(frozen=True)
class Node:
    alias: str
    label: str | None = None
    props: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    """types: none for any. hops (m, n): a path of m to n edges. direction: out, in or both."""

    types: tuple[str, ...] = ()
    hops: tuple[int, int] | None = None
    direction: str = "out"
    alias: str | None = None


def node(alias: str, label: str | None = None, **props: object) -> Node:
    return Node(alias, label, props)


def edge(*types: str, hops: tuple[int, int] | None = None, direction: str = "out", alias: str | None = None) -> Edge:
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction {direction!r} is none of out, in, both")
    if hops and not 0 <= hops[0] <= hops[1]:
        raise ValueError(f"hops {hops} must be (least, most)")
    return Edge(types, hops, direction, alias)


def property_is(df: DataFrame, name: str, value: object) -> Column:
    """A column if there is one of that name, else a key of the JSON in properties, compared by the value's type."""
    if name in df.columns:
        return F.col(name) == F.lit(value)
    found = F.get_json_object("properties", f"$.{name}")
    if isinstance(value, bool):
        return found == F.lit(str(value).lower())
    if isinstance(value, (int, float)):
        return found.try_cast("double") == F.lit(float(value))
    return found == F.lit(value)


def fitting(nodes: DataFrame, n: Node) -> DataFrame:
    out = nodes if n.label is None else nodes.where(F.col("label") == n.label)
    for name, value in n.props.items():
        out = out.where(property_is(nodes, name, value))
    return out


def directed(edges: DataFrame, e: Edge) -> DataFrame:
    own = edges.where(F.col("type").isin(*e.types)) if e.types else edges
    back = own.withColumns({"from_id": F.col("to_id"), "to_id": F.col("from_id")})
    return {"out": own, "in": back, "both": own.unionByName(back.where(F.col("from_id") != F.col("to_id")))}[e.direction]


def prefixed(df: DataFrame, alias: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{alias}_{c}") for c in df.columns])


def match(
    nodes: DataFrame,
    edges: DataFrame,
    pattern: Sequence[Node | Edge],
    where: Column | None = None,
    returns: Sequence[Column | str] | None = None,
    order_by: Sequence[Column | str] = (),
    skip: int = 0,
    limit: int | None = None,
    split_hubs: float | None = None,
) -> DataFrame:
    """All matches, a row each. Node columns are alias_column, those of an edge with an alias too.

    A stretch of several hops adds path_i, amplification_i and depth_i for the i-th such stretch; its paths visit no node
    twice, (0, n) includes the start itself, and conditions on its ends hold for its first and last node only. Label
    and property conditions are applied before the joins; edges of unknown nodes match nothing. Order, then skip, then limit.

    With split_hubs, a share, edges that begin or end in a node with that share of all edges or more are dealt by a salt.
    """
    first, rest = pattern[0], list(pattern[1:])
    if not isinstance(first, Node) or len(rest) % 2 or any(isinstance(p, Node) != bool(i % 2) for i, p in enumerate(rest)):
        raise ValueError("a pattern alternates nodes and edges and begins and ends with a node")
    found, last, stretches = prefixed(fitting(nodes, first), first.alias), first.alias, 0
    for e, n in zip(rest[::2], rest[1::2], strict=True):
        here, ends = F.col(f"{last}_id"), prefixed(fitting(nodes, n), n.alias)
        hops = directed(edges, e)
        if e.hops is None:
            kept = prefixed(hops, e.alias) if e.alias else hops.select("from_id", "to_id")
            source, target = (f"{e.alias}_from_id", f"{e.alias}_to_id") if e.alias else ("from_id", "to_id")
            if split_hubs:
                found = hub_join(found, kept, f"{last}_id", source, split_hubs)
                found = hub_join(ends, found, f"{n.alias}_id", target, split_hubs, keys=hub_keys(kept, target, split_hubs))
            else:
                found = found.join(kept, here == F.col(source)).join(ends, F.col(target) == F.col(f"{n.alias}_id"))
            found = found if e.alias else found.drop("from_id", "to_id")
        else:
            starts = found.select(here.alias("id")).distinct()
            # long stretches to chosen nodes are followed only where they can still end there
            chosen = (n.label is not None or n.props) and e.hops[1] > 3
            paths = expand(starts, hops, *e.hops, ends=fitting(nodes, n).select("id") if chosen else None, split_hubs=split_hubs)
            names = {c: f"_{c}" if c in ("start", "end") else f"{c}_{stretches}" for c in ("start", "end", "path", "amplification", "depth")}
            paths = paths.select(*[F.col(c).alias(a) for c, a in names.items()])
            found = found.join(paths, here == F.col("_start")).join(ends, F.col("_end") == F.col(f"{n.alias}_id")).drop("_start", "_end")
            stretches += 1
        last = n.alias
    found = found if where is None else found.where(where)
    found = found if returns is None else found.select(*returns)
    found = found.orderBy(*order_by) if order_by else found
    found = found.offset(skip) if skip else found
    return found if limit is None else found.limit(limit)
