"""The ten requests, their plans, and their execution on a view."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..errors import ValidationError
from ..functions.scores import PROFILE
from ..model import EDGE_RECORD, NODE_RECORD, GraphView, check_id, wrap
from ..operators import lookup, paths, ranking, traversal, vectors
from ..operators.traversal import Constraints
from .predicates import Predicate


@dataclass(frozen=True)
class Plan:
    kind: str
    filters: tuple[tuple[str, dict], ...] = ()


@dataclass
class Result:
    """A record of a ranked result is in nodes and in ranked; response_items counts it once."""

    plan: Plan
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    ranked: DataFrame | None = None
    path: paths.GraphPath | None = None
    profile: str | None = None
    truncated: bool = False

    def items(self) -> Iterator[tuple[str, Any]]:
        """(kind, record) one by one: nodes, edges, ranked results, the path."""
        for kind, rows, names in (("node", self.nodes if self.ranked is None else None, NODE_RECORD.names), ("edge", self.edges, EDGE_RECORD.names), ("ranked", self.ranked, None)):
            if rows is not None:
                for row in (rows.select(*names) if names else rows).toLocalIterator():
                    yield kind, row.asDict(recursive=True)
        if self.path is not None:
            yield "path", {"node_ids": list(self.path.node_ids), "edge_ids": list(self.path.edge_ids), "hop_count": self.path.hop_count}

    def checked(self, most: int = config.RESPONSE_ITEMS) -> list[tuple[str, Any]]:
        out = []
        for item in self.items():
            out.append(item)
            if len(out) > most:
                raise ValidationError(f"the response has more than {most} items")
        return out


def _plan(kind: str, **filters: Any) -> Plan:
    return Plan(kind, tuple((k, wrap(v)) for k, v in filters.items() if v is not None))


class Request:
    def plan(self) -> Plan:
        raise NotImplementedError

    def run(self, view: GraphView, settings: config.VectorConfig) -> Result:
        raise NotImplementedError


@dataclass(frozen=True)
class GetNodeById(Request):
    node_id: str

    def plan(self) -> Plan:
        check_id(self.node_id)
        return Plan("ExactLookup")

    def run(self, view: GraphView, settings: config.VectorConfig) -> Result:
        return Result(self.plan(), lookup.by_id(view, self.node_id))


@dataclass(frozen=True)
class GetNodeByUniqueKey(Request):
    unique_key: str

    def plan(self) -> Plan:
        return _plan("ExactLookup", unique_key=self.unique_key)

    def run(self, view: GraphView, settings: config.VectorConfig) -> Result:
        return Result(self.plan(), lookup.by_unique_key(view, self.unique_key))


@dataclass(frozen=True)
class FilterNodes(Request):
    where: Predicate
    label: str | None = None
    limit: int | None = None

    def plan(self) -> Plan:
        self.where.validate()
        if self.label is not None and not self.label.strip():
            raise ValidationError("filter label cannot be empty")
        return _plan("FilterScan", limit=config.result_limit(self.limit), label=self.label, predicate_count=self.where.leaves())

    def run(self, view: GraphView, settings: config.VectorConfig) -> Result:
        return Result(self.plan(), lookup.filtered(view, self.where, self.label, self.limit))


@dataclass(frozen=True)
class ListNeighbors(Request):
    node_id: str
    direction: str
    edge_type: str | None = None
    limit: int | None = None

    def plan(self) -> Plan:
        return _plan("NeighborLookup", limit=config.result_limit(self.limit))

    def run(self, view: GraphView, settings: config.VectorConfig) -> Result:
        return Result(self.plan(), *traversal.neighbors(view, self.node_id, self.direction, self.edge_type, self.limit))


@dataclass(frozen=True)
class Traverse(Request):
    start_node_id: str
    direction: str
    edge_type: str | None = None
    max_hops: int | None = None
    limit: int | None = None
    timeout_ms: int | None = None
    constraints: dict = field(default_factory=dict)

    def plan(self) -> Plan:
        Constraints.of(self.edge_type, **self.constraints)
        return _plan("Traversal", max_hops=config.depth(self.max_hops), limit=config.result_limit(self.limit), timeout_ms=config.timeout_ms(self.timeout_ms))

    def run(self, view: GraphView, settings: config.VectorConfig) -> Result:
        limits = Constraints.of(self.edge_type, **self.constraints)
        nodes, edges, truncated = traversal.traverse(view, self.start_node_id, self.direction, self.max_hops, self.limit, self.timeout_ms, limits)
        return Result(self.plan(), nodes, edges, truncated=truncated)


@dataclass(frozen=True)
class ShortestPath(Request):
    source_node_id: str
    target_node_id: str
    direction: str
    max_depth: int | None = None
    limit: int | None = None
    timeout_ms: int | None = None
    constraints: dict = field(default_factory=dict)

    def plan(self) -> Plan:
        Constraints.of(**self.constraints)
        return _plan("ShortestPath", max_depth=config.depth(self.max_depth), limit=config.result_limit(self.limit), timeout_ms=config.timeout_ms(self.timeout_ms))

    def run(self, view: GraphView, settings: config.VectorConfig) -> Result:
        found = paths.shortest_path(view, self.source_node_id, self.target_node_id, self.direction, self.max_depth, self.limit, self.timeout_ms, Constraints.of(**self.constraints))
        if found.path is None:
            return Result(self.plan(), truncated=found.truncated)
        return Result(self.plan(), *paths.path_records(view, found.path), path=found.path)


@dataclass(frozen=True)
class SearchByLabel(Request):
    label: str
    limit: int | None = None

    def plan(self) -> Plan:
        if not self.label.strip():
            raise ValidationError("label cannot be empty")
        return _plan("LabelScan", label=self.label, limit=config.result_limit(self.limit))

    def run(self, view: GraphView, settings: config.VectorConfig) -> Result:
        return Result(self.plan(), lookup.by_label(view, self.label, self.limit))


@dataclass(frozen=True)
class TimeRange(Request):
    field: str
    from_epoch_ms: int
    to_epoch_ms: int
    limit: int

    def plan(self) -> Plan:
        if not self.field.strip():
            raise ValidationError("time range field cannot be empty")
        if self.from_epoch_ms > self.to_epoch_ms:
            raise ValidationError("time range start is after its end")
        return _plan("TemporalRange", field=self.field, limit=config.result_limit(self.limit))

    def run(self, view: GraphView, settings: config.VectorConfig) -> Result:
        return Result(self.plan(), lookup.in_time_range(view, self.field, self.from_epoch_ms, self.to_epoch_ms, self.limit))


@dataclass(frozen=True)
class VectorSearch(Request):
    query_vector: tuple[float, ...]
    limit: int
    node_type: str | None = None
    vector_name: str | None = None
    top_k: int | None = None

    def plan(self) -> Plan:
        if not self.query_vector:
            raise ValidationError("query_vector cannot be empty")
        top_k = None if self.top_k is None else config.result_limit(self.top_k)
        return _plan("VectorSimilarity", limit=config.result_limit(self.limit), vector_name=self.vector_name or config.DEFAULT_VECTOR, top_k=top_k, node_type=self.node_type)

    def run(self, view: GraphView, settings: config.VectorConfig) -> Result:
        plan = self.plan()
        rows = vectors.search(view, list(self.query_vector), self.limit, self.node_type, self.vector_name, self.top_k, settings)
        return Result(plan, rows.drop("score"), ranked=rows)


@dataclass(frozen=True)
class RankedRetrieval(Request):
    limit: int
    now_epoch_ms: int
    query_vector: tuple[float, ...] | None = None
    reference_node_id: str | None = None
    edge_type: str | None = None
    from_epoch_ms: int | None = None
    to_epoch_ms: int | None = None
    vector_name: str | None = None
    top_k: int | None = None
    retrieval_profile: str | None = None

    def plan(self) -> Plan:
        if self.query_vector is None and self.reference_node_id is None:
            raise ValidationError("ranked retrieval needs a query_vector or a reference_node_id")
        if self.retrieval_profile not in (None, PROFILE):
            raise ValidationError(f"unknown retrieval profile: {self.retrieval_profile}")
        top_k = None if self.top_k is None else config.result_limit(self.top_k)
        return _plan("RankedHybrid", limit=config.result_limit(self.limit), vector_name=self.vector_name or config.DEFAULT_VECTOR, top_k=top_k)

    def run(self, view: GraphView, settings: config.VectorConfig) -> Result:
        plan = self.plan()
        query = None if self.query_vector is None else list(self.query_vector)
        rows = ranking.ranked(view, self.limit, self.now_epoch_ms, query, self.reference_node_id, self.edge_type, self.from_epoch_ms, self.to_epoch_ms, self.vector_name, self.top_k, self.retrieval_profile, settings)
        return Result(plan, rows.drop("score", *(f"{x}_score" for x in ranking.S.WEIGHTS)), ranked=rows, profile=PROFILE)


REQUESTS = {x.__name__: x for x in (GetNodeById, GetNodeByUniqueKey, FilterNodes, ListNeighbors, Traverse, ShortestPath, SearchByLabel, TimeRange, VectorSearch, RankedRetrieval)}


def parse(message: dict) -> Request:
    """{"Name": {fields}} as a request."""
    if len(message) != 1 or next(iter(message)) not in REQUESTS:
        raise ValidationError(f"a request has one name of {', '.join(REQUESTS)}")
    (name, content), kind = next(iter(message.items())), REQUESTS[next(iter(message))]
    known = {f.name for f in fields(kind)}
    if unknown := set(content) - known:
        raise ValidationError(f"{name} has no {', '.join(sorted(unknown))}")
    content = {k: v for k, v in content.items() if v is not None}
    if "where" in content:
        content["where"] = Predicate.parse(content["where"])
    if isinstance(content.get("query_vector"), list):
        content["query_vector"] = tuple(content["query_vector"])
    try:
        return kind(**content)
    except TypeError as e:
        raise ValidationError(str(e)) from None


def execute(view: GraphView, request: Request | dict, settings: config.VectorConfig = config.VectorConfig()) -> Result:
    return (parse(request) if isinstance(request, dict) else request).run(view, settings)


def stream(result: Result, most_items: int = config.STREAM_ITEMS, most_bytes: int = config.STREAM_BYTES) -> Iterator[str]:
    """JSON lines: meta, items, end. Rows come from the executors as they are asked for."""
    import json

    yield json.dumps({"type": "meta", "plan": result.plan.kind, "retrieval_profile": result.profile})
    size = n = 0
    for kind, record in result.items():
        line = json.dumps({"type": kind, **record}, default=str)
        size, n = size + len(line.encode()) + 1, n + 1
        if n > most_items or size > most_bytes:
            raise ValidationError("the stream is over its budget")
        yield line
    yield json.dumps({"type": "end", "items": n, "truncated": result.truncated})


def count_by_label(view: GraphView) -> DataFrame:
    """How many nodes each label has: the sizes that a label index would hold."""
    return view.nodes.groupBy("node_type").agg(F.count("*").alias("nodes"))
