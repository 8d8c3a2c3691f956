"""Unweighted shortest paths by search from both ends."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..model import GraphView
from .traversal import HOP_ROWS, OUTGOING, REVERSED, Constraints, steps


@dataclass(frozen=True)
class GraphPath:
    node_ids: tuple[str, ...]
    edge_ids: tuple[str, ...]

    @property
    def hop_count(self) -> int:
        return len(self.edge_ids)


@dataclass(frozen=True)
class PathResult:
    path: GraphPath | None
    truncated: bool = False  # a budget ended the search, so that there may be a path


def shortest_path(view: GraphView, source: str, target: str, direction: str = OUTGOING, max_depth: int | None = None, limit: int | None = None, timeout_ms: int | None = None, constraints: Constraints = Constraints()) -> PathResult:
    """max_depth bounds each side, limit the visited nodes of both, which bounds what the driver holds. Ends may have
    any label, nodes between must match. A level keeps the smallest edge id to each new node; of several meetings, that with the smallest edge ids holds."""
    depth, limit, deadline = config.depth(max_depth), config.result_limit(limit), time.monotonic() + config.timeout_ms(timeout_ms) / 1000
    known = {r["id"] for r in view.nodes.where(F.col("id").isin(source, target)).select("id").collect()}
    if known != {source, target}:
        return PathResult(None)
    if source == target:
        return PathResult(GraphPath((source,), ()))
    typed = Constraints(constraints.edge_types)
    ways = [steps(view, direction, typed), steps(view, REVERSED[direction], typed)]
    allowed = None
    if constraints.node_labels:
        allowed = view.nodes.where(F.col("node_type").isin(*constraints.node_labels) | F.col("id").isin(source, target)).select(F.col("id").alias("far"))
        ways = [w.join(allowed, "far", "left_semi") for w in ways]
    parents: list[dict[str, tuple[str, str] | None]] = [{source: None}, {target: None}]
    fronts, depths, side = [[source], [target]], [0, 0], 0

    def back(side: int, node: str) -> tuple[list[str], list[str]]:
        nodes, edges = [node], []
        while (up := parents[side][nodes[-1]]) is not None:
            nodes.append(up[0])
            edges.append(up[1])
        return nodes, edges

    while fronts[0] and fronts[1] and (depths[0] < depth or depths[1] < depth):
        if time.monotonic() > deadline or len(parents[0]) + len(parents[1]) >= limit:
            return PathResult(None, True)
        if depths[side] >= depth:
            side = 1 - side
            continue
        near = ways[side].where(F.col("near").isin(*fronts[side])).select("near", "far", "id")
        few = near.limit(HOP_ROWS + 1).collect()
        if len(few) <= HOP_ROWS:  # a level of so many steps is one job
            met = sorted((r for r in few if r["far"] in parents[1 - side]), key=lambda r: r["id"])[:limit]
        else:
            met = near.where(F.col("far").isin(*parents[1 - side])).orderBy("id").limit(limit).collect()
        if met:
            found = []
            for r in met:
                own, own_edges = back(side, r["near"])
                other, other_edges = back(1 - side, r["far"])
                nodes, edges = [*own[::-1], *other], [*own_edges[::-1], r["id"], *other_edges]
                found.append((len(edges), tuple(edges if not side else edges[::-1]), tuple(nodes if not side else nodes[::-1])))
            _, edges, nodes = min(found)
            return PathResult(GraphPath(nodes, edges))
        if len(few) <= HOP_ROWS:
            by: dict[str, tuple[str, str]] = {}
            for r in few:
                if r["far"] not in parents[side]:
                    by[r["far"]] = min(by.get(r["far"], (r["id"], r["near"])), (r["id"], r["near"]))
            fresh = [(far, *by[far]) for far in sorted(by)[:limit]]
        else:
            rows = near.where(~F.col("far").isin(*parents[side])).groupBy("far").agg(F.min(F.struct("id", "near")).alias("by")).orderBy("far").limit(limit).collect()
            fresh = [(r["far"], r["by"]["id"], r["by"]["near"]) for r in rows]
        fronts[side] = []
        for far, edge, before in fresh:
            parents[side][far] = (before, edge)
            fronts[side].append(far)
        depths[side] += 1
        side = 1 - side
    return PathResult(None)


def path_records(view: GraphView, path: GraphPath) -> tuple[DataFrame, DataFrame]:
    nodes = view.spark.createDataFrame([(i, k) for k, i in enumerate(path.node_ids)], "id string, position int")
    edges = view.spark.createDataFrame([(i, k) for k, i in enumerate(path.edge_ids)], "id string, position int")
    own = view.nodes.where(F.col("id").isin(list(path.node_ids))), view.edges.where(F.col("id").isin(list(path.edge_ids)))
    return own[0].join(F.broadcast(nodes), "id"), own[1].join(F.broadcast(edges), "id")
