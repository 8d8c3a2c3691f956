"""Duplicates to merge, isolated nodes to demote, stale nodes to archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import signal
from ..model import GraphView, column_value, promote

STALE_MS = 30 * 24 * 3600 * 1000


def merges(view: GraphView) -> DataFrame:
    """target, related: of each (node_type, unique_key) with two nodes or more the smallest id, and the others in order."""
    groups = view.nodes.where("unique_key is not null").groupBy("node_type", "unique_key").agg(F.min("id").alias("target"), F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    return groups.select("node_type", "unique_key", "target", F.slice("ids", F.lit(2), F.size("ids") - 1).alias("related"))


def isolated(view: GraphView) -> DataFrame:
    ends = view.edges.select(F.col("source").alias("id")).unionByName(view.edges.select(F.col("target").alias("id"))).distinct()
    return view.nodes.join(ends, "id", "left_anti")


def stale(view: GraphView, now_epoch_ms: int) -> DataFrame:
    return view.nodes.where(F.lit(now_epoch_ms) - F.col("timestamp_ms") > STALE_MS)


def analyse(view: GraphView, now_epoch_ms: int) -> DataFrame:
    """action (Merge, Demote, Archive), target, related: merges by (type, key), then demote before archive by id; see rank columns."""
    none = F.array().cast("array<string>")
    made = merges(view).select(F.lit("Merge").alias("action"), "target", "related", F.lit(0).alias("part"), F.concat_ws("\u0000", "node_type", "unique_key").alias("at"))
    for action, rows, part in (("Demote", isolated(view), 1), ("Archive", stale(view, now_epoch_ms), 1)):
        made = made.unionByName(rows.select(F.lit(action).alias("action"), F.col("id").alias("target"), none.alias("related"), F.lit(part).alias("part"), F.col("id").alias("at")))
    return made.withColumn("step", F.when(F.col("action") == "Archive", 1).otherwise(0))


def _set(properties: Column, when: Column, key: str, made: Column) -> Column:
    return F.when(when, F.map_concat(F.map_filter(properties, lambda k, _: k != key), F.map_from_arrays(F.array(F.lit(key)), F.array(made)))).otherwise(properties)


def apply(view: GraphView, events: DataFrame) -> tuple[GraphView, DataFrame]:
    """The view after the events, and the changed nodes as they were, which undo them. Duplicates get merged_into and archived, demoted nodes half their importance (of 0.5 if it
    is missing), archived nodes archived."""
    merged = events.where("action = 'Merge'").select(F.explode("related").alias("id"), F.col("target").alias("_into")).groupBy("id").agg(F.max("_into").alias("_into"))
    times = lambda action, name: events.where(F.col("action") == action).groupBy(F.col("target").alias("id")).agg(F.count("*").alias(name))
    marked = view.nodes.join(merged, "id", "left").join(times("Demote", "_down"), "id", "left").join(times("Archive", "_old"), "id", "left")
    changed = F.coalesce("_into", F.col("_down").cast("string"), F.col("_old").cast("string")).isNotNull()
    before = marked.where(changed).select(*view.nodes.columns)
    p = _set(F.col("properties"), F.col("_into").isNotNull(), "merged_into", column_value("String", F.coalesce("_into", F.lit(""))))
    p = _set(p, F.col("_into").isNotNull() | F.col("_old").isNotNull(), "archived", column_value("Boolean", F.lit(True)))
    p = _set(p, F.col("_down").isNotNull(), "importance", column_value("Float", F.coalesce("importance", F.lit(0.5)) * F.pow(F.lit(0.5), F.coalesce("_down", F.lit(0)))))
    return GraphView(promote(marked.withColumn("properties", p)), view.edges, view.version), before


def importance_of(view: GraphView) -> DataFrame:
    return view.nodes.select("id", signal(F.col("importance")).alias("importance"))
