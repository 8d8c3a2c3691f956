"""Stores of the first format: JSON snapshots of nodes and edges under a manifest of checksums."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CorruptionError, SerializationError
from ..model import GraphView
from .files import Files
from .jsonl import RECORD, frames

# The format's number and its folders.
FORMAT = 1
FOLDERS = {"nodes": "node", "edges": "edge"}


def read(spark: SparkSession, root: str) -> GraphView:
    """The graph of a store of that format; files whose checksum differs from the manifest's, or that are no snapshot, fail. A missing
    file or manifest is an error; a store without records is an empty graph. Snapshots are parsed on the executors, a file a row."""
    root = root.rstrip("/")
    try:
        listed = json.loads(Files(spark).read(f"{root}/manifest.json"))["files"]
    except (ValueError, KeyError, TypeError) as e:
        raise CorruptionError(f"manifest: {e}") from None
    found = []
    for entry in listed.values():
        folder = entry["relative_path"].split("/")[0]
        if folder in FOLDERS and entry["relative_path"].endswith(".json"):
            found.append(_records(spark, f"{root}/{entry['relative_path']}", FOLDERS[folder], entry["checksum_crc32"]))
    if not found:
        raise CorruptionError("the manifest names no snapshot")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    nodes, edges = frames(rows)
    return GraphView(nodes, edges)


def _records(spark: SparkSession, path: str, kind: str, checksum: int) -> DataFrame:
    shape = T.StructType([T.StructField("format_version", T.IntegerType()), T.StructField("records", T.ArrayType(RECORD))])
    whole = spark.read.text(path, wholetext=True)
    if not whole.where(F.crc32(F.col("value").cast("binary")) != checksum).isEmpty():
        raise CorruptionError(f"{path}: checksum")
    parsed = whole.select(F.from_json("value", shape).alias("s"))
    if not parsed.where(F.col("s.records").isNull() | (F.coalesce("s.format_version", F.lit(0)) != FORMAT)).isEmpty():
        raise SerializationError(f"{path}: no snapshot of format {FORMAT}")
    named = F.transform("s.records", lambda r: r.withField("type", F.lit(kind)))
    return parsed.select(F.explode(named).alias("r")).select(F.to_json("r").alias("value"), "r")
