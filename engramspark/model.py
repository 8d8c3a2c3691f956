"""Nodes and edges as DataFrames: schemas, property values, promoted columns, views."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ValidationError
from .functions.values import as_double, as_long

_KINDS = {"kind": T.StringType(), "s": T.StringType(), "i": T.LongType(), "f": T.DoubleType(), "b": T.BooleanType(), "sl": T.ArrayType(T.StringType()), "fl": T.ArrayType(T.FloatType())}
VALUE = T.StructType([T.StructField(k, v) for k, v in _KINDS.items()])
NODE_RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("node_type", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), VALUE)), T.StructField("vectors", T.MapType(T.StringType(), T.ArrayType(T.FloatType())))])
EDGE_RECORD = T.StructType([*(T.StructField(c, T.StringType()) for c in ("id", "source", "target", "edge_type")), T.StructField("properties", T.MapType(T.StringType(), VALUE))])
#: kind -> the field of VALUE that holds it. Fixed names.
KINDS = {"String": "s", "Integer": "i", "Float": "f", "Boolean": "b", "StringList": "sl", "FloatList": "fl"}
PROMOTED = ["namespace", "unique_key", "timestamp_ms", "importance", "confidence"]
ID = re.compile(r"[A-Za-z0-9_:-]+")


def value(kind: str, content: Any) -> dict:
    if kind not in KINDS:
        raise ValidationError(f"unknown property kind: {kind}")
    return {"kind": kind, **{c: content if c == KINDS[kind] else None for c in KINDS.values()}}


def wrap(content: Any) -> dict:
    """A Python value as a property value; a dict with kind and value is taken as it is."""
    if isinstance(content, dict) and "kind" in content:
        return value(content["kind"], content["value"]) if "value" in content else content
    for kind, types in (("Boolean", bool), ("Integer", int), ("Float", float), ("String", str)):
        if isinstance(content, types):
            return value(kind, content)
    if isinstance(content, (list, tuple)):
        if all(isinstance(x, str) for x in content):
            return value("StringList", list(content))
        if all(isinstance(x, (int, float)) for x in content):
            return value("FloatList", [float(x) for x in content])
    raise ValidationError(f"no property value: {content!r}")


def column_value(kind: str, content: Column) -> Column:
    """A property value of one kind made of a column; null where the column is null."""
    made = F.struct(F.lit(kind).alias("kind"), *((content if c == KINDS[kind] else F.lit(None)).cast(VALUE[c].dataType).alias(c) for c in KINDS.values()))
    return F.when(content.isNotNull(), made)


def properties(**columns: tuple[str, Column]) -> Column:
    """A property map of (kind, column) by key, without the keys whose column is null."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), column_value(*v).alias("value")) for k, v in columns.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def no_properties() -> Column:
    return F.create_map().cast(T.MapType(T.StringType(), VALUE))


def check_id(identifier: str) -> str:
    if not identifier or not ID.fullmatch(identifier):
        raise ValidationError(f"identifier must be of ASCII letters, digits, '-', '_' and ':': {identifier!r}")
    return identifier


def namespace_of(identifier: str) -> str | None:
    return identifier.split(":", 1)[0] if ":" in identifier else None


def _name(name: str, what: str) -> str:
    if not name or not name.strip():
        raise ValidationError(f"{what} cannot be empty")
    return name


def node(identifier: str, node_type: str, properties: dict | None = None, vectors: dict | None = None) -> dict:
    made = {_name(k, "property key"): wrap(v) for k, v in (properties or {}).items()}
    check_metadata(made)
    return {"id": check_id(identifier), "node_type": _name(node_type, "node_type"), "properties": made, "vectors": {_name(k, "vector name"): [float(x) for x in v] for k, v in (vectors or {}).items()}}


def edge(identifier: str, source: str, target: str, edge_type: str, properties: dict | None = None) -> dict:
    return {"id": check_id(identifier), "source": check_id(source), "target": check_id(target), "edge_type": _name(edge_type, "edge_type"), "properties": {_name(k, "property key"): wrap(v) for k, v in (properties or {}).items()}}


def check_metadata(made: dict[str, dict]) -> None:
    if "embedding" in made:
        raise ValidationError("a vector does not go into properties as embedding: give it a name under vectors")
    for key in ("timestamp", "importance", "confidence"):
        if key in made and made[key]["kind"] not in ("Integer", "Float"):
            raise ValidationError(f"{key} takes a number, not {made[key]['kind']}")


def promote(nodes: DataFrame) -> DataFrame:
    """Record columns and the reserved properties as plain columns, which reach Parquet's statistics."""
    p = F.col("properties")
    return nodes.select(
        *NODE_RECORD.names,
        F.when(F.instr("id", ":") > 0, F.substring_index("id", ":", 1)).alias("namespace"),
        F.when(p["unique_key"]["kind"] == "String", p["unique_key"]["s"]).alias("unique_key"),
        as_long(p["timestamp"]).alias("timestamp_ms"),
        as_double(p["importance"]).alias("importance"),
        as_double(p["confidence"]).alias("confidence"),
    )


def nodes_frame(spark: SparkSession, records: Iterable[dict]) -> DataFrame:
    return promote(spark.createDataFrame([(r["id"], r["node_type"], r["properties"], r["vectors"]) for r in records], NODE_RECORD))


def edges_frame(spark: SparkSession, records: Iterable[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[c] for c in EDGE_RECORD.names) for r in records], EDGE_RECORD)


@dataclass(frozen=True)
class GraphView:
    """What every operator reads: a pinned pair of DataFrames."""

    nodes: DataFrame
    edges: DataFrame
    version: int = 0
    vector_index: Any = field(default=None, compare=False)
    #: The same edges laid out by target, for steps against their direction; the edges themselves where there is no such copy.
    incoming: DataFrame | None = field(default=None, compare=False)

    @property
    def edges_by_target(self) -> DataFrame:
        return self.edges if self.incoming is None else self.incoming

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @staticmethod
    def of(spark: SparkSession, nodes: Iterable[dict], edges: Iterable[dict] = ()) -> GraphView:
        return GraphView(nodes_frame(spark, nodes), edges_frame(spark, edges))

    def overlay(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, removed_nodes: DataFrame | None = None, removed_edges: DataFrame | None = None) -> GraphView:
        """This view under added records and removed ids (column id), which hide records of the same id. Edges at a removed node go with it."""
        own_nodes = self.nodes
        for frame in (removed_nodes, nodes):
            if frame is not None:
                own_nodes = own_nodes.join(frame.select("id"), "id", "left_anti")
        own_nodes = own_nodes.select(*self.nodes.columns) if nodes is None else own_nodes.unionByName(nodes)
        gone = None
        if removed_nodes is not None:
            gone = removed_nodes.select("id") if nodes is None else removed_nodes.select("id").join(nodes.select("id"), "id", "left_anti")

        def overlaid(own: DataFrame) -> DataFrame:
            for frame in (removed_edges, edges):
                if frame is not None:
                    own = own.join(frame.select("id"), "id", "left_anti")
            own = own.select(*self.edges.columns) if edges is None else own.unionByName(edges)
            if gone is not None:
                for end in ("source", "target"):
                    own = own.join(gone.withColumnRenamed("id", end), end, "left_anti")
            return own.select(*self.edges.columns)

        return GraphView(own_nodes, overlaid(self.edges), self.version, incoming=None if self.incoming is None else overlaid(self.incoming))
