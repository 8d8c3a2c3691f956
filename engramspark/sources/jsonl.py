"""JSON lines: {"type": "node" | "edge", ...record}, nodes first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SerializationError
from ..model import EDGE_RECORD, KINDS, NODE_RECORD, VALUE, GraphView, promote

_TEXT = T.MapType(T.StringType(), T.StringType())


def _written(properties: str):
    """Values as {"kind", "value"}."""
    def one(_, v):
        cells = [F.when(v["kind"] == k, F.to_json(F.struct(F.lit(k).alias("kind"), v[c].alias("value")))) for k, c in KINDS.items()]
        return F.coalesce(*cells)

    body = F.transform(F.map_entries(F.transform_values(properties, one)), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(F.array_sort(body), ","), F.lit("}"))


def lines(view: GraphView) -> DataFrame:
    """part (0 nodes, 1 edges), id, value."""
    def line(kind: str, frame: DataFrame, plain: list[str], part: int) -> DataFrame:
        head = F.to_json(F.struct(F.lit(kind).alias("type"), *plain))
        return frame.select(F.lit(part).alias("part"), "id", F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"properties":'), _written("properties"), F.lit("}")).alias("value"))

    return line("node", view.nodes, ["id", "node_type", "vectors"], 0).unionByName(line("edge", view.edges, ["id", "source", "target", "edge_type"], 1))


def export(view: GraphView, path: str) -> None:
    """A folder of text files whose rows, in the order of the files' names, are the nodes and then the edges, each by id."""
    lines(view).repartitionByRange("part", "id").sortWithinPartitions("part", "id").select("value").write.mode("overwrite").text(path)


#: A record as JSON has it; property values stay text until their kind is known.
RECORD = T.StructType([*(T.StructField(n, T.StringType()) for n in ("type", "id", "node_type", "source", "target", "edge_type")), T.StructField("properties", _TEXT), T.StructField("vectors", NODE_RECORD["vectors"].dataType)])


def _typed(_, text):
    kind = F.get_json_object(text, "$.kind")
    cells = [F.when(kind == k, F.from_json(text, T.StructType([T.StructField("value", VALUE[c].dataType)]))["value"]).cast(VALUE[c].dataType).alias(c) for k, c in KINDS.items()]
    return F.struct(kind.alias("kind"), *cells)


def frames(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parsed (value, r: a RECORD) -> (nodes, edges); one record that is neither fails all."""
    bad = parsed.where("r.type is null or r.type not in ('node', 'edge') or r.id is null or (r.type = 'node' and r.node_type is null) or (r.type = 'edge' and (r.source is null or r.target is null or r.edge_type is null))")
    if first := bad.select("value").head(1):
        raise SerializationError(f"no node or edge: {first[0]['value'][:200]}")
    properties = F.coalesce(F.transform_values("r.properties", _typed), F.create_map().cast(T.MapType(T.StringType(), VALUE))).alias("properties")
    vectors = F.coalesce("r.vectors", F.create_map().cast(NODE_RECORD["vectors"].dataType)).alias("vectors")
    nodes = promote(parsed.where("r.type = 'node'").select("r.id", "r.node_type", properties, vectors))
    return nodes, parsed.where("r.type = 'edge'").select(*(f"r.{c}" for c in EDGE_RECORD.names[:-1]), properties)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). Blank lines are skipped; one bad line fails all."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return frames(rows.select("value", F.from_json("value", RECORD, {"mode": "PERMISSIVE"}).alias("r")))
