"""python -m engramspark BASE COMMAND ...: a store from the command line; answers are JSON."""

from __future__ import annotations

import argparse
import json
import sys
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import VectorConfig
from .errors import EngramError, NotFoundError
from .functions.stats import nearest_rank
from .model import EDGE_RECORD, NODE_RECORD, GraphView, edge, node
from .operators import consolidation, vectors
from .plans.requests import count_by_label, execute, stream
from .service import AuditLog, Cluster, prometheus, latency_histogram
from .sources import jsonl, legacy
from .sources.store import Batch, Store, sums
from .streaming.replication import Follower

COMMANDS: dict[str, tuple[Callable, list[tuple]]] = {}


def command(*arguments: tuple):
    """arguments: (name, type[, default]); one with a default is an option."""

    def add(run: Callable) -> Callable:
        COMMANDS[run.__name__.replace("_", "-")] = (run, list(arguments))
        return run

    return add


def _record(text: str) -> dict:
    return json.loads(sys.stdin.read() if text == "-" else text)


def _node(record: dict) -> dict:
    return node(record["id"], record["node_type"], record.get("properties"), record.get("vectors"))


def _edge(record: dict) -> dict:
    return edge(record["id"], record["source"], record["target"], record["edge_type"], record.get("properties"))


def _found(rows) -> dict:
    some = rows.head(1)
    if not some:
        raise NotFoundError("no such record")
    return some[0].asDict(recursive=True)


@command()
def status(store: Store) -> dict:
    """Version, commits, snapshots, and what compaction would fold."""
    return {"version": store.version, "commits": len(store.versions()), "pruned": store.pruned(), "problems": store.verify()}


@command()
def labels(store: Store) -> dict:
    """How many nodes each label has."""
    return {r["node_type"]: r["nodes"] for r in count_by_label(store.view()).orderBy("node_type").collect()}


@command(("path", str))
def import_lines(store: Store, path: str) -> dict:
    """Writes the nodes and edges of JSON lines as one commit."""
    nodes, edges = jsonl.read(store.spark, path)
    return {"version": store.write_frames(nodes, edges)}


@command(("path", str))
def import_legacy(store: Store, path: str) -> dict:
    """Writes the graph of a store of the first format as one commit."""
    view = legacy.read(store.spark, path)
    return {"version": store.write_frames(view.nodes, view.edges)}


@command(("path", str), ("--version", int, None))
def export_lines(store: Store, path: str, version: int | None) -> dict:
    """Writes a version as JSON lines."""
    view = store.view(version)
    jsonl.export(view, path)
    return {"version": view.version, "path": path}


@command(("id", str), ("--version", int, None))
def get_node(store: Store, id: str, version: int | None) -> dict:
    return _found(store.view(version).nodes.where(F.col("id") == id).select(*NODE_RECORD.names))


@command(("id", str), ("--version", int, None))
def get_edge(store: Store, id: str, version: int | None) -> dict:
    return _found(store.view(version).edges.where(F.col("id") == id).select(*EDGE_RECORD.names))


@command(("record", _record))
def put_node(store: Store, record: dict) -> dict:
    return {"version": store.write(Batch(nodes=[_node(record)]))}


@command(("record", _record))
def put_edge(store: Store, record: dict) -> dict:
    return {"version": store.write(Batch(edges=[_edge(record)]))}


@command(("id", str))
def delete_node(store: Store, id: str) -> dict:
    get_node(store, id, None)
    return {"version": store.write(Batch(node_deletes=[id]))}


@command(("id", str))
def delete_edge(store: Store, id: str) -> dict:
    get_edge(store, id, None)
    return {"version": store.write(Batch(edge_deletes=[id]))}


@command(("batch", _record))
def write(store: Store, batch: dict) -> dict:
    """A batch {"nodes", "edges", "node_deletes", "edge_deletes"} as one commit."""
    made = Batch(list(map(_node, batch.get("nodes", []))), list(map(_edge, batch.get("edges", []))), batch.get("node_deletes", []), batch.get("edge_deletes", []))
    return {"version": store.write(made)}


@command(("request", _record), ("--version", int, None))
def query(store: Store, request: dict, version: int | None) -> dict:
    result = execute(store.view(version), request)
    return {"plan": result.plan.kind, "truncated": result.truncated, "items": [{"type": kind, **record} for kind, record in result.checked()]}


@command(("request", _record), ("--version", int, None))
def query_lines(store: Store, request: dict, version: int | None) -> None:
    """The same as JSON lines, one by one."""
    for line in stream(execute(store.view(version), request)):
        print(line)


@command()
def compact(store: Store) -> dict:
    return {"version": store.compact()}


@command(("--keep", int, 0))
def prune(store: Store, keep: int) -> dict:
    return {"dropped": store.prune(keep)}


@command()
def verify(store: Store) -> dict:
    return {"problems": store.verify()}


@command()
def repair(store: Store) -> dict:
    return {"gone": store.repair()}


@command(("target", str))
def backup(store: Store, target: str) -> dict:
    return store.backup(target)


@command(("source", str), ("--version", int, None))
def restore(store: Store, source: str, version: int | None) -> dict:
    """Restores a backup as this store, which must not exist."""
    return {"version": Store.restore(store.spark, source, store.base, version).version}


def _state(view: GraphView) -> dict:
    return {"nodes": sums(view.nodes.select(*NODE_RECORD.names)), "edges": sums(view.edges.select(*EDGE_RECORD.names))}


@command(("--folder", str, None))
def drill(store: Store, folder: str | None) -> dict:
    """Backs up, restores elsewhere, verifies, and compares both graphs; cleans up."""
    base, began, steps = folder or f"{store.base}.drill-{uuid.uuid4().hex}", time.perf_counter(), {}

    def timed(name: str, run: Callable):
        at, out = time.perf_counter(), run()
        steps[name] = round(time.perf_counter() - at, 3)
        return out

    try:
        timed("backup", lambda: store.backup(f"{base}/backup"))
        restored = timed("restore", lambda: Store.restore(store.spark, f"{base}/backup", f"{base}/restored"))
        problems = timed("verify", restored.verify)
        same = timed("compare", lambda: restored.version == store.version and _state(restored.view()) == _state(store.view()))
    finally:
        store.files.delete(base)
    return {"passed": same and not problems, "problems": problems, "version": store.version, "seconds": steps, "total": round(time.perf_counter() - began, 3)}


@command(("--vector", str, None))
def index(store: Store, vector: str | None) -> dict:
    made = store.build_index(vector)
    return {"name": made.name, "dimension": made.dimension, "vectors": made.size, "cells": len(made.centroids)}


@command()
def rebuild_indexes(store: Store) -> dict:
    return {"indexes": store.rebuild_indexes()}


@command(("--every", int, 20), ("--k", int, 10))
def index_quality(store: Store, every: int, k: int) -> dict:
    """Recall at k of the index over a share of its own vectors as queries."""
    view = store.view()
    if view.vector_index is None:
        raise NotFoundError("there is no index of the newest version")
    memory = vectors.space(view, view.vector_index.name)
    queries = memory.where(F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(every)) == 0).select(F.col("id").alias("query_id"), "vector")
    got = vectors.recall(vectors.search_batch(memory, queries, k), view.vector_index.search_batch(queries, k, VectorConfig().probes), k).first()
    return {"queries": got["queries"], "recall": got["recall"]}


@command(("--now", int, None), ("--apply", int, 0))
def consolidate(store: Store, now: int | None, apply: int) -> dict:
    """What consolidation would do and, with --apply 1, does."""
    view, now = store.view(), int(time.time() * 1000) if now is None else now
    events = consolidation.analyse(view, now)
    counts = {r["action"]: r["count"] for r in events.groupBy("action").count().collect()}
    if not apply or not counts:
        return {"events": counts}
    after, _ = consolidation.apply(view, events)
    changed = after.nodes.select(*NODE_RECORD.names)
    return {"events": counts, "version": store.write_frames(changed, None)}


@command(("leader", str))
def pull(store: Store, leader: str) -> dict:
    """Applies a leader's commits that this store has not."""
    follower = Follower(Store(store.spark, leader), store)
    return {"applied": follower.pull(), "version": store.version, "lag": follower.lag}


@command()
def topology(store: Store) -> dict:
    cluster = Cluster.load(store.files, f"{store.base}/cluster")
    return {"term": cluster.term, "members": cluster.topology()}


@command(("--last", int, 100))
def audit(store: Store, last: int) -> None:
    for line in AuditLog(store.spark, f"{store.base}/audit").export(last):
        print(line)


@command()
def metrics(store: Store) -> None:
    print(prometheus(latency_histogram(AuditLog(store.spark, f"{store.base}/audit").frame())), end="")


@command(("--percents", str, "50,95,99"))
def latencies(store: Store, percents: str) -> dict:
    """Nearest-rank percentiles of the audited calls' milliseconds."""
    rows = nearest_rank(AuditLog(store.spark, f"{store.base}/audit").frame(), "ms", [float(p) for p in percents.split(",")])
    return {f"p{r['percent']:g}": r["value"] for r in rows.collect()}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="engramspark", description=__doc__)
    out.add_argument("base", help="folder of the store")
    commands = out.add_subparsers(dest="command", required=True)
    for name, (run, arguments) in COMMANDS.items():
        sub = commands.add_parser(name, help=(run.__doc__ or name.replace("-", " ")).splitlines()[0])
        for argument, kind, *default in arguments:
            sub.add_argument(argument, type=kind, **({"default": default[0]} if default else {}))
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 with the error's kind and message on stderr."""
    given = vars(parser().parse_args(argv))
    base, (run, _) = given.pop("base"), COMMANDS[given.pop("command")]
    own = spark or SparkSession.builder.appName("engramspark").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        answer = run(Store(own, base), **given)
        if answer is not None:
            print(json.dumps(answer, default=str))
        return 0
    except EngramError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
