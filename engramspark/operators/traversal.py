"""Neighbours, bounded breadth-first search, distances."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..errors import ValidationError
from ..lineage import cut
from ..model import EDGE_RECORD, GraphView

OUTGOING, INCOMING, BOTH = "Outgoing", "Incoming", "Both"
REVERSED = {OUTGOING: INCOMING, INCOMING: OUTGOING, BOTH: BOTH}
#: Rows of one hop that the driver takes at once; a hop with more is cut to its limits, or joined, on the executors.
HOP_ROWS = 10_000


@dataclass(frozen=True)
class Constraints:
    edge_types: tuple[str, ...] = ()
    node_labels: tuple[str, ...] = ()

    @staticmethod
    def of(edge_type: str | None = None, edge_types: Sequence[str] = (), node_labels: Sequence[str] = ()) -> Constraints:
        types = [*edge_types, *([edge_type] if edge_type is not None and edge_type not in edge_types else [])]
        if any(not x.strip() for x in (*types, *node_labels)):
            raise ValidationError("constraints cannot be empty strings")
        return Constraints(tuple(types), tuple(node_labels))


def steps(view: GraphView, direction: str, constraints: Constraints = Constraints()) -> DataFrame:
    """near, far, back (0 outgoing, 1 incoming), and the edge, for each way to walk an edge. Under Both, a
    self-loop is walked once. Far ends that miss the node labels are left out."""
    if direction not in REVERSED:
        raise ValidationError(f"unknown direction: {direction}")
    typed = lambda edges: edges.where(F.col("edge_type").isin(*constraints.edge_types)) if constraints.edge_types else edges
    ways = []
    if direction != INCOMING:
        ways.append(typed(view.edges).select(F.col("source").alias("near"), F.col("target").alias("far"), F.lit(0).alias("back"), "id", "source", "target", "edge_type", "properties"))
    if direction != OUTGOING:
        rows = typed(view.edges_by_target)
        rows = rows.where("source <> target") if direction == BOTH else rows
        ways.append(rows.select(F.col("target").alias("near"), F.col("source").alias("far"), F.lit(1).alias("back"), "id", "source", "target", "edge_type", "properties"))
    out = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])
    if constraints.node_labels:
        allowed = view.nodes.where(F.col("node_type").isin(*constraints.node_labels)).select(F.col("id").alias("far"))
        out = out.join(allowed, "far", "left_semi")
    return out


def neighbors(view: GraphView, node_id: str, direction: str = BOTH, edge_type: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the first limit edges, outgoing before incoming and then by id, and their far ends, each once."""
    picked = steps(view, direction, Constraints.of(edge_type)).where(F.col("near") == node_id).orderBy("back", "id").limit(config.result_limit(limit))
    rows = picked.select("far", *EDGE_RECORD.names).collect()  # at most limit, so that the nodes' scan gets their ids
    edges = view.spark.createDataFrame([tuple(r)[1:] for r in rows], EDGE_RECORD)
    return view.nodes.where(F.col("id").isin({r["far"] for r in rows})), edges


@dataclass
class Traversal:
    nodes: list[tuple[str, int]]  # (id, depth) in the order of discovery
    edges: list[str]  # edge ids in the order of their expansion
    truncated: bool = False


def _rank(column: str, ids: Sequence[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, ids)), F.col(column))


def traverse_ids(view: GraphView, start: str, direction: str, max_hops: int | None, limit: int | None, timeout_ms: int | None, constraints: Constraints) -> Traversal:
    """Breadth-first with caps. Each hop brings at most limit edges and limit nodes to the driver, in the order (rank
    of the expanded node, outgoing first, edge id); the graph itself stays where it is. A hop of at most HOP_ROWS steps is one job."""
    hops, limit, deadline = config.depth(max_hops), config.result_limit(limit), time.monotonic() + config.timeout_ms(timeout_ms) / 1000
    if view.nodes.where(F.col("id") == start).select("id").isEmpty():
        return Traversal([], [])
    out, frontier, seen, walked = Traversal([(start, 0)], []), [start], {start}, set()
    ways = steps(view, direction, constraints)
    for depth in range(1, hops + 1):
        if not frontier or len(seen) >= limit:
            out.truncated |= bool(frontier)
            break
        if time.monotonic() > deadline:
            out.truncated = True
            break
        near = ways.where(F.col("near").isin(*frontier))
        rank = {x: i for i, x in enumerate(frontier)}
        few = near.select("near", "back", "id", "far").limit(HOP_ROWS + 1).collect()
        if len(few) <= HOP_ROWS:
            ordered = sorted((rank[r["near"]], r["back"], r["id"], r["far"]) for r in few)
            edges, nodes = [x[2] for x in ordered], list(dict.fromkeys(x[3] for x in ordered if x[3] not in seen))
        else:
            near, order = near.withColumn("rank", _rank("near", frontier)), ["rank", "back", "id"]
            edges = [r["id"] for r in near.select("id", *order[:2]).orderBy(*order).limit(limit + 1 + len(walked)).collect()] if len(out.edges) <= limit else []
            fresh = near.where(~F.col("far").isin(*seen)).groupBy("far").agg(F.min(F.struct(*order)).alias("first")).orderBy("first").limit(limit + 1 - len(seen)).select("far")
            nodes = [r["far"] for r in fresh.collect()]
        for i in edges:
            if i not in walked:
                if len(out.edges) >= limit:
                    out.truncated = True
                    break
                walked.add(i)
                out.edges.append(i)
        out.truncated |= len(nodes) > limit - len(seen)
        frontier = nodes[: limit - len(seen)]
        seen.update(frontier)
        out.nodes += [(i, depth) for i in frontier]
    return out


def traverse(view: GraphView, start: str, direction: str = OUTGOING, max_hops: int | None = None, limit: int | None = None, timeout_ms: int | None = None, constraints: Constraints = Constraints()) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes with depth, edges, truncated) within max_hops, at most limit of each. A missing start gives nothing; when time runs
    out, what was found so far. truncated says that a limit or the time left something out. The start may have any label."""
    found = traverse_ids(view, start, direction, max_hops, limit, timeout_ms, constraints)
    spark = view.spark
    depths = spark.createDataFrame([(i, d, k) for k, (i, d) in enumerate(found.nodes)], "id string, depth int, rank int")
    ids = spark.createDataFrame([(i, k) for k, i in enumerate(found.edges)], "id string, rank int")
    # both are bounded by the limit, and their ids reach the scans
    nodes = view.nodes.where(F.col("id").isin([i for i, _ in found.nodes])).join(F.broadcast(depths), "id")
    edges = view.edges.where(F.col("id").isin(found.edges)).join(F.broadcast(ids), "id")
    return nodes, edges, found.truncated


def reachable(view: GraphView, starts: DataFrame, max_hops: int, direction: str = OUTGOING, constraints: Constraints = Constraints()) -> DataFrame:
    """starts (id) -> start, id, depth for all nodes within max_hops of each start, without caps: one join a hop for all starts together.
    A pair is expanded once, at its smallest depth. Each hop is written to the shared folder, so that the next one reads it, and a lost executor
    costs its own tasks of one hop. Hubs that many starts reach are split by adaptive skew joins, their steps being read once a split."""
    first = starts.select(F.col("id").alias("start"), "id").join(view.nodes.select("id"), "id", "left_semi").distinct()
    levels = [cut(first.select("start", "id", F.lit(0).alias("depth")))]
    ways = steps(view, direction, constraints).select("near", "far")
    for depth in range(1, max_hops + 1):
        found = levels[-1].join(ways, F.col("id") == F.col("near")).select("start", F.col("far").alias("id")).distinct()
        for level in levels:
            found = found.join(level.select("start", "id"), ["start", "id"], "left_anti")
        fresh = found.withColumn("depth", F.lit(depth))
        if depth == max_hops:
            levels.append(fresh)
            break
        fresh = cut(fresh)
        if fresh.isEmpty():
            break
        levels.append(fresh)
    return reduce(DataFrame.unionByName, levels)


def distances(view: GraphView, start: str, max_depth: int = 3, edge_type: str | None = None) -> DataFrame:
    """id, distance of all nodes within max_depth undirected hops; the start has 0; nothing if it is missing. A ball of at
    most HOP_ROWS steps a hop is followed on the driver, whose ids reach the scans; a larger one by joins."""
    ways, spark = steps(view, BOTH, Constraints.of(edge_type)).select("near", "far"), view.spark
    if view.nodes.where(F.col("id") == start).select("id").isEmpty():
        return spark.createDataFrame([], "id string, distance int")
    found, frontier = {start: 0}, [start]
    for depth in range(1, max_depth + 1):
        rows = ways.where(F.col("near").isin(frontier)).select("far").limit(HOP_ROWS + 1).collect()
        if len(rows) > HOP_ROWS:
            starts = view.nodes.where(F.col("id") == start).select("id")
            return cut(reachable(view, starts, max_depth, BOTH, Constraints.of(edge_type)).select("id", F.col("depth").alias("distance")))
        frontier = sorted({r["far"] for r in rows} - found.keys())
        found |= dict.fromkeys(frontier, depth)
        if not frontier:
            break
    return spark.createDataFrame(list(found.items()), "id string, distance int")


def traversed_edges(view: GraphView, starts: DataFrame, max_hops: int, direction: str = OUTGOING, constraints: Constraints = Constraints()) -> DataFrame:
    """start, id of the edges that leave a node within max_hops - 1 of a start, without caps."""
    inner = reachable(view, starts, max_hops - 1, direction, constraints).select("start", F.col("id").alias("near"))
    return steps(view, direction, constraints).join(inner, "near").select("start", "id").distinct()
