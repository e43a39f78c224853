"""Table schemas of the property graph and its satellites, vocabularies, and schema helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A fingerprint holds 10,000 bits in 157 words of 64; the last word has 16 of them.
BITS, WORDS, LAST_MASK = 10_000, 157, 0xFFFF
# Vocabularies (fixed values).
EDGE_TYPES = {
    "causal": ["CAUSES", "AMPLIFIES", "DAMPENS", "TRIGGERS", "ENABLES", "PREVENTS"],
    "structural": ["CONTAINS", "EXTENDS", "IMPLEMENTS", "DEPENDS_ON"],
    "semantic": ["SIMILAR_TO", "CONTRADICTS", "REFINES", "ABSTRACTS"],
    "learning": ["YIELDS", "SUPPORTS", "RECALLS"],
    "workflow": ["HANDS_OVER", "RESOLVES", "BLOCKS", "FOLLOWS"],
}
LABEL_TYPES = {
    "cognitive": ["Thought", "Concept", "LearningMoment", "MemoryScent"],
    "workflow": ["Decision", "Blocker", "Resolution", "Handover"],
    "agents": ["Agent", "Session", "Task"],
    "code": ["Atom", "Module", "Dependency"],
}
#: Labels of the qualia index, 32 values each.
QIDX_LABELS = ["crisis", "struggling", "working", "flowing", "engaged", "excited", "breakthrough", "transcendent"]
THINKING_STYLES = ["analytical", "creative", "practical", "empathetic", "strategic", "detailed", "intuitive"]
CAUSAL_TYPES = ["CAUSES", "CORRELATES", "AMPLIFIES", "DAMPENS", "DELAYS", "ENABLES", "PREVENTS", "TRIGGERS"]
IMPACT_TYPES = ["FUNCTIONAL", "PERFORMANCE", "SECURITY", "STABILITY", "MAINTENANCE"]
AGENT_ROLES = ["orchestrator", "analyst", "archaeologist", "developer", "reviewer", "tester", "product_sage", "meta_learner"]
MESSAGE_TYPES = ["task", "question", "answer", "decision", "blocker", "handover", "observe", "resonance"]
NODE_TYPES = ["Node", "Thought", "Concept", "LearningMoment", "Decision", "Blocker"]
GATES = ["FLOW", "HOLD", "BLOCK"]


def _struct(required: str, **optional: T.DataType) -> T.StructType:
    fields = [T.StructField(n, T.StringType(), False) for n in required.split()]
    return T.StructType(fields + [T.StructField(n, t, True) for n, t in optional.items()])


_S, _F, _NTZ = T.StringType(), T.FloatType(), T.TimestampNTZType()
NODES = _struct(
    "id label", fingerprint=T.BinaryType(), embedding=T.ArrayType(_F), qidx=T.ShortType(), thinking_style=T.ArrayType(_F), scent=T.ArrayType(_F), content=_S,
    properties=_S, created_at=_NTZ, updated_at=_NTZ, version=T.LongType(), created_by=_S,
)
EDGES = _struct("id from_id to_id type", weight=_F, amplification=_F, confidence=_F, properties=_S, created_at=_NTZ, created_by=_S)
CONCEPTS = _struct(
    "id label", fingerprint=T.BinaryType(), embedding=T.ArrayType(_F), content=_S, definition=_S, examples=T.ArrayType(_S), evidence_count=T.IntegerType(),
    confidence=_F, properties=_S, created_at=_NTZ, updated_at=_NTZ, version=T.LongType(),
)
LEARNING_MOMENTS = _struct(
    "id label", fingerprint=T.BinaryType(), content=_S, qidx=T.ShortType(), certainty=_F, novelty=_F, effort=_F, satisfaction=_F, surprise=_F, clarity=_F,
    connection=_F, session_id=_S, agent_id=_S, task=_S, is_breakthrough=T.BooleanType(), concept_id=_S, created_at=_NTZ,
)
DECISIONS = _struct("id label", fingerprint=T.BinaryType(), content=_S, rationale=_S, gate=_S, agent_id=_S, task_id=_S, properties=_S, created_at=_NTZ)
HANDOVERS = _struct(
    "id label", from_agent=_S, to_agent=_S, task=_S, context=_S, decisions_made=_S, files_modified=T.ArrayType(_S), blockers=T.ArrayType(_S),
    next_steps=T.ArrayType(_S), resonance_hits=T.ArrayType(_S), created_at=_NTZ,
)
TABLES = {"nodes": NODES, "edges": EDGES, "concepts": CONCEPTS, "learning_moments": LEARNING_MOMENTS, "decisions": DECISIONS, "handovers": HANDOVERS}


def get_schema(table: str) -> T.StructType:
    if table not in TABLES:
        raise KeyError(f"no table {table!r}; there are {', '.join(TABLES)}")
    return TABLES[table]


def add_column(df: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    """Schema evolution that keeps the default for the rows there are."""
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(kind))


def remove_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def schema_to_ddl(schema: T.StructType, table: str) -> str:
    columns = (f"`{f.name}` {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in schema)
    return f"CREATE TABLE `{table}` ({', '.join(columns)})"


def qidx_label(qidx: Column) -> Column:
    """The bucket's label; "unknown" for null and for values beyond 0 to 255."""
    return F.coalesce(F.get(F.array(*map(F.lit, QIDX_LABELS)), F.floor(qidx / 32).cast("int")), F.lit("unknown"))


def node_type(label: Column) -> Column:
    """The typed node that a label makes; labels without one are plain nodes."""
    return F.when(label.isin(NODE_TYPES), label).otherwise(NODE_TYPES[0])


def style_distance(style: Column, target: list[float]) -> Column:
    """The Euclidean distance of thinking styles, vectors of the seven dimensions."""
    squares = F.zip_with(style, F.array(*[F.lit(float(x)) for x in target]), lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def to_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def from_json(df: DataFrame, schema: T.StructType, name: str = "json") -> DataFrame:
    return df.select(F.from_json(name, schema).alias("r")).select("r.*")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's columns: present ones cast, missing ones null, the others gathered as JSON in properties."""
    known = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType) for f in schema]
    extra = [c for c in df.columns if c not in schema.names]
    out = df.select(*(c.alias(f.name) for c, f in zip(known, schema, strict=True)), *extra)
    if extra and "properties" in schema.names:
        out = out.withColumn("properties", F.coalesce("properties", F.to_json(F.struct(*extra))))
    return out.select(*schema.names)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
