"""Point lookups, label and time scans, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..errors import ValidationError
from ..functions.values import as_long
from ..model import GraphView
from ..plans.predicates import Predicate


def by_id(view: GraphView, node_id: str) -> DataFrame:
    return view.nodes.where(F.col("id") == node_id)


def by_unique_key(view: GraphView, unique_key: str) -> DataFrame:
    """At most one node; of several with the key, the one with the largest id."""
    return view.nodes.where(F.col("unique_key") == unique_key).orderBy(F.desc("id")).limit(1)


def by_label(view: GraphView, label: str, limit: int | None = None) -> DataFrame:
    if not label.strip():
        raise ValidationError("label cannot be empty")
    return view.nodes.where(F.col("node_type") == label).orderBy("id").limit(config.result_limit(limit))


def filtered(view: GraphView, where: Predicate, label: str | None = None, limit: int | None = None) -> DataFrame:
    if label is not None and not label.strip():
        raise ValidationError("filter label cannot be empty")
    where.validate()
    rows = view.nodes if label is None else view.nodes.where(F.col("node_type") == label)
    return rows.where(where.compile()).orderBy("id").limit(config.result_limit(limit))


def in_time_range(view: GraphView, field: str, start_ms: int, end_ms: int, limit: int) -> DataFrame:
    """Both ends count. The field timestamp is ordered by time and id, any other by id."""
    if not field.strip():
        raise ValidationError("time range field cannot be empty")
    if start_ms > end_ms:
        raise ValidationError("time range start is after its end")
    limit = config.result_limit(limit)
    if field == "timestamp":
        return view.nodes.where(F.col("timestamp_ms").between(start_ms, end_ms)).orderBy("timestamp_ms", "id").limit(limit)
    return view.nodes.where(as_long(F.col("properties")[field]).between(start_ms, end_ms)).orderBy("id").limit(limit)


def within(nodes: DataFrame, start_ms: int | None, end_ms: int | None) -> DataFrame:
    """No bound: all. Any bound: nodes without a timestamp go."""
    if start_ms is not None:
        nodes = nodes.where(F.col("timestamp_ms") >= start_ms)
    return nodes if end_ms is None else nodes.where(F.col("timestamp_ms") <= end_ms)
