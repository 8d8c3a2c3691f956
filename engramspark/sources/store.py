"""A versioned store on plain files: batches, snapshot-isolated transactions, compaction, checks, backup.

    base/_commits/<version>.json   one file a commit, made in one step: the point at which a batch exists
    base/data/<version>-<token>/   its upserts and deletes as Parquet
    base/snapshots/<version>/      nodes, and edges by source and by target, as of a version, written by compact()
    base/indexes/<version>/<name>/ inverted files over the vectors of a version

Versions only ever grow. A reader pins one and sees the newest snapshot up to it under the later commits. Commits and snapshots
hold the row count and an order-free checksum of each table."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import DEFAULT_VECTOR, VectorConfig
from ..errors import ConflictError, CorruptionError, NotFoundError, ValidationError
from ..model import EDGE_RECORD, NODE_RECORD, GraphView, check_metadata, edges_frame, namespace_of, nodes_frame, promote
from .files import Files

if TYPE_CHECKING:
    from ..operators.vectors import InvertedFile

PARTS = ("nodes", "edges", "node_deletes", "edge_deletes")
SNAPSHOT = ("nodes", "edges", "edges_by_target")


@dataclass
class Batch:
    """Records to write and ids to delete. What a batch both writes and deletes ends deleted."""

    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    node_deletes: list[str] = field(default_factory=list)
    edge_deletes: list[str] = field(default_factory=list)

    def __bool__(self) -> bool:
        return any((self.nodes, self.edges, self.node_deletes, self.edge_deletes))


def sums(frame: DataFrame) -> dict[str, int]:
    """Rows, and the sum of the rows' checksums, whatever their order."""
    line = F.to_json(F.struct(*(F.col(c) for c in sorted(frame.columns))))
    got = frame.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.crc32(line.cast("binary"))), F.lit(0)).cast("long").alias("crc32")).first()
    return {"rows": got["rows"], "crc32": got["crc32"]}


def _ids(spark: SparkSession, ids: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


class Store:
    def __init__(self, spark: SparkSession, base: str, source: str = "local", term: int = 1):
        self.spark, self.base, self.source, self.term = spark, base.rstrip("/"), source, term
        self.files = Files(spark)

    # what there is

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.base}/_commits") if n.endswith(".json") and n[0].isdigit()]

    @property
    def version(self) -> int:
        """The newest, commits that compaction has folded in included."""
        return max([0, *self.versions(), *self._snapshots()])

    def _snapshots(self) -> list[int]:
        return [int(n) for n in self.files.names(f"{self.base}/snapshots") if n.isdigit() and self.files.exists(f"{self.base}/snapshots/{n}/manifest.json")]

    def pruned(self) -> int:
        """The newest version whose commit was dropped; 0 if none was."""
        versions = self.versions()
        return versions[0] - 1 if versions else max([0, *self._snapshots()])

    def commit_record(self, version: int) -> dict:
        raw = self.files.read(f"{self.base}/_commits/{version:020d}.json")
        try:
            record = json.loads(raw)
            content = json.dumps(record["content"], sort_keys=True)
            if zlib.crc32(content.encode()) != record["crc32"]:
                raise CorruptionError(f"commit {version}: checksum")
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptionError(f"commit {version}: {e}") from None
        return record["content"]

    def view(self, version: int | None = None) -> GraphView:
        """The graph as of a version, the newest by default."""
        newest = self.version
        version = newest if version is None else version
        if not 0 <= version <= newest:
            raise NotFoundError(f"version {version}")
        start = max([0, *(v for v in self._snapshots() if v <= version)])
        if version < self.pruned() and version not in self._snapshots() or version and not start and min(self.versions(), default=1) > 1:
            raise NotFoundError(f"version {version} is older than the oldest snapshot")
        later = [v for v in self.versions() if start < v <= version]
        incoming = None
        if start:
            read = lambda t: self.spark.read.parquet(f"{self.base}/snapshots/{start}/{t}")
            nodes, edges = read("nodes"), read("edges")
            if self.files.exists(f"{self.base}/snapshots/{start}/edges_by_target"):
                incoming = read("edges_by_target")
        else:
            nodes, edges = nodes_frame(self.spark, []), edges_frame(self.spark, [])
        if later:
            paths = {v: self.commit_record(v)["path"] for v in later}
            nodes = self._folded(nodes, "nodes", paths)
            edges, incoming = self._folded(edges, "edges", paths), None if incoming is None else self._folded(incoming, "edges", paths)
        return GraphView(nodes, edges, version, self.index(version), incoming)

    def _folded(self, base: DataFrame, which: str, paths: dict[int, str]) -> DataFrame:
        """Of each id the newest row; a delete counts after a write of its own commit. Only the commits' rows are ranked; base keeps its
        layout, and filters on it reach its files."""
        schema, deletes = {"nodes": (NODE_RECORD, "node_deletes"), "edges": (EDGE_RECORD, "edge_deletes")}[which]
        rows = None
        for version, path in paths.items():
            made = self.spark.read.schema(schema).parquet(f"{self.base}/{path}/{which}").withColumn("_gone", F.lit(False))
            gone = self.spark.read.schema("id string").parquet(f"{self.base}/{path}/{deletes}").withColumn("_gone", F.lit(True))
            both = made.unionByName(gone, allowMissingColumns=True).withColumn("_version", F.lit(version).cast("long"))
            rows = both if rows is None else rows.unionByName(both)
        newest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_version"), F.desc("_gone")))
        live = rows.withColumn("_n", newest).where("_n = 1 and not _gone").select(*schema.names)
        untouched = base.join(rows.select("id"), "id", "left_anti").select(*base.columns)
        return untouched.unionByName(promote(live) if which == "nodes" else live)

    # indexes

    def build_index(self, vector_name: str | None = None, settings: VectorConfig = VectorConfig()) -> InvertedFile:
        """An inverted file over the newest version; views of that version have it from then on, also in other sessions."""
        from ..operators.vectors import build_index

        view = self.view()
        return build_index(view, f"{self.base}/indexes/{view.version}/{vector_name or DEFAULT_VECTOR}", vector_name, settings)

    def index(self, version: int, vector_name: str | None = None) -> InvertedFile | None:
        from ..operators.vectors import InvertedFile

        path = f"{self.base}/indexes/{version}/{vector_name or DEFAULT_VECTOR}"
        return InvertedFile.open(self.spark, path) if self.files.exists(f"{path}/index.json") else None

    def rebuild_indexes(self, settings: VectorConfig = VectorConfig()) -> list[str]:
        """Builds anew, for the newest version, each index that any version has; drops those of older versions."""
        folders = [v for v in self.files.names(f"{self.base}/indexes") if v.isdigit()]
        names = sorted({n for v in folders for n in self.files.names(f"{self.base}/indexes/{v}")})
        for name in names:
            self.build_index(name, settings)
        for v in folders:
            if int(v) != self.version:
                self.files.delete(f"{self.base}/indexes/{v}")
        return names

    # writing

    def write(self, batch: Batch, expected: int | None = None) -> int:
        """Checks a batch, writes its files and commits them as the next version, which it returns."""
        if not batch:
            raise ValidationError("a batch cannot be empty")
        for record in batch.nodes:
            check_metadata(record["properties"])
        last = lambda records: list({r["id"]: r for r in records}.values())
        return self.write_frames(nodes_frame(self.spark, last(batch.nodes)), edges_frame(self.spark, last(batch.edges)), _ids(self.spark, set(batch.node_deletes)), _ids(self.spark, set(batch.edge_deletes)), expected)

    def write_frames(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, node_deletes: DataFrame | None = None, edge_deletes: DataFrame | None = None, expected: int | None = None) -> int:
        """The same for DataFrames of any size, of distinct ids: checks are joins."""
        spark, now = self.spark, self.view()
        if expected is not None and expected != now.version:
            raise ConflictError(f"version is {now.version}, not {expected}")
        nodes = nodes_frame(spark, []) if nodes is None else nodes
        edges = edges_frame(spark, []) if edges is None else edges
        node_deletes = _ids(spark, []) if node_deletes is None else node_deletes.select("id")
        edge_deletes = _ids(spark, []) if edge_deletes is None else edge_deletes.select("id")
        self.check(now, nodes, edges)
        # edges at a deleted node go with it, those of this batch included
        at_node = now.edges.select("id", "source", "target").unionByName(edges.select("id", "source", "target"))
        for end in ("source", "target"):
            edge_deletes = edge_deletes.unionByName(at_node.join(node_deletes.withColumnRenamed("id", end), end, "left_semi").select("id"))
        version = now.version + 1
        path, made = f"data/{version:020d}-{uuid.uuid4().hex}", {}
        frames = (nodes.select(*NODE_RECORD.names), edges.select(*EDGE_RECORD.names), node_deletes.distinct(), edge_deletes.distinct())
        for name, frame in zip(PARTS, frames):
            frame.write.parquet(f"{self.base}/{path}/{name}")
            made[name] = sums(spark.read.schema(frame.schema).parquet(f"{self.base}/{path}/{name}"))
        try:
            self._publish(version, {"version": version, "term": self.term, "source": self.source, "path": path, "rows": {k: v["rows"] for k, v in made.items()}, "sums": {k: v["crc32"] for k, v in made.items()}})
        except ConflictError:
            self.files.delete(f"{self.base}/{path}")
            raise
        return version

    def _publish(self, version: int, content: dict) -> None:
        text = json.dumps(content, sort_keys=True)
        try:
            self.files.write(f"{self.base}/_commits/{version:020d}.json", json.dumps({"content": content, "crc32": zlib.crc32(text.encode())}).encode())
        except ConflictError:
            raise ConflictError(f"version {version} was committed meanwhile") from None

    @staticmethod
    def check(view: GraphView, nodes: DataFrame, edges: DataFrame) -> None:
        bad = nodes.where(F.map_contains_key("properties", F.lit("embedding"))).select("id").head(1)
        if bad:
            raise ValidationError(f"{bad[0]['id']}: a vector does not go into properties as embedding")
        wrong = None
        for key in ("timestamp", "importance", "confidence"):
            kind = F.col("properties")[key]["kind"]
            test = kind.isNotNull() & ~kind.isin("Integer", "Float")
            wrong = test if wrong is None else wrong | test
        if bad := nodes.where(wrong).select("id").head(1):
            raise ValidationError(f"{bad[0]['id']}: timestamp, importance and confidence take numbers")
        known = view.nodes.select("id").unionByName(nodes.select("id"))
        for end in ("source", "target"):
            if bad := edges.join(known, edges[end] == known["id"], "left_anti").select(edges["id"], end).head(1):
                raise ValidationError(f"edge {bad[0][0]}: no node {bad[0][1]}")
        space = lambda c: F.when(F.instr(c, ":") > 0, F.substring_index(c, ":", 1)).otherwise("")
        if bad := edges.where(space("source") != space("target")).select("id").head(1):
            raise ValidationError(f"edge {bad[0]['id']} crosses namespaces")

    # upkeep

    def compact(self) -> int:
        """Writes a snapshot of the newest version; readers of it need no commits. Versions go on from there."""
        view = self.view()
        if not view.version or view.version in self._snapshots():
            return view.version
        path = f"{self.base}/snapshots/{view.version}"
        view.nodes.repartitionByRange("node_type", "timestamp_ms", "id").sortWithinPartitions("node_type", "timestamp_ms", "id").write.mode("overwrite").parquet(f"{path}/nodes")
        self._lay_out(view.edges, f"{path}/edges", "source")
        self._lay_out(self.spark.read.parquet(f"{path}/edges"), f"{path}/edges_by_target", "target")
        made = {t: sums(self.spark.read.parquet(f"{path}/{t}")) for t in SNAPSHOT}
        self.files.write(f"{path}/manifest.json", json.dumps({"version": view.version, "rows": {t: x["rows"] for t, x in made.items()}, "sums": {t: x["crc32"] for t, x in made.items()}}).encode())
        return view.version

    @staticmethod
    def _lay_out(edges: DataFrame, path: str, end: str) -> None:
        edges.repartitionByRange(end, "id").sortWithinPartitions(end, "id").write.mode("overwrite").parquet(path)

    def prune(self, keep: int = 0) -> list[int]:
        """Compacts, then drops the commits, data, older snapshots and older indexes that the newest snapshot has folded in, but for the last keep
        commits before it, which need the snapshot that comes before them. Versions that are dropped can no longer be read. Returns the dropped commits."""
        newest = self.compact()
        wanted = newest - keep
        floor = max([0, *(v for v in self._snapshots() if v <= wanted)])
        dropped = [v for v in self.versions() if v <= floor]
        for v in dropped:  # the commit first: without it, its data is nothing
            path = self.commit_record(v)["path"]
            self.files.delete(f"{self.base}/_commits/{v:020d}.json")
            self.files.delete(f"{self.base}/{path}")
        for v in self._snapshots():
            if v < floor:
                self.files.delete(f"{self.base}/snapshots/{v}")
        for v in self.files.names(f"{self.base}/indexes"):
            if v.isdigit() and int(v) < floor:
                self.files.delete(f"{self.base}/indexes/{v}")
        return dropped

    def verify(self) -> list[str]:
        """What is wrong: gaps, checksums of commit records, missing files, row counts and checksums of data. Empty if all is well."""
        found, versions = [], self.versions()
        floor = min([*self._snapshots(), *versions], default=0)
        if missing := set(range(min(versions, default=1), max(versions, default=0) + 1)) - set(versions):
            found.append(f"commits are missing: {sorted(missing)}")
        if versions and versions[0] > 1 and floor > versions[0] - 1:
            found.append(f"no snapshot before commit {versions[0]}")

        def compared(what: str, name: str, path: str, schema: StructType | str | None, record: dict) -> None:
            try:
                there = sums((self.spark.read.schema(schema) if schema is not None else self.spark.read).parquet(path))
            except Exception as e:
                found.append(f"{what}: {str(e).splitlines()[0][:200]}")
                return
            if there["rows"] != record["rows"].get(name, there["rows"]):
                found.append(f"{what}: {name} has {there['rows']} rows, not {record['rows'][name]}")
            elif there["crc32"] != record.get("sums", {}).get(name, there["crc32"]):
                found.append(f"{what}: {name} was changed")

        schemas = dict(zip(PARTS, (NODE_RECORD, EDGE_RECORD, "id string", "id string")))
        for v in versions:
            try:
                record = self.commit_record(v)
            except CorruptionError as e:
                found.append(str(e))
                continue
            for name in PARTS:
                compared(f"commit {v}", name, f"{self.base}/{record['path']}/{name}", schemas[name], record)
        for v in self._snapshots():
            record = json.loads(self.files.read(f"{self.base}/snapshots/{v}/manifest.json"))
            for name in record["rows"]:
                compared(f"snapshot {v}", name, f"{self.base}/snapshots/{v}/{name}", None, record)
        return found

    def repair(self) -> list[str]:
        """Drops broken snapshots while the commits can replace them, and trailing commits that cannot be read; says what went."""
        gone = []
        for problem in self.verify():
            kind, _, rest = problem.partition(" ")
            number = rest.split(":")[0]
            if kind == "snapshot" and min(self.versions(), default=2) == 1 and number.isdigit():
                self.files.delete(f"{self.base}/snapshots/{number}")
                gone.append(f"snapshot {number}")
            elif kind == "commit" and number.isdigit() and int(number) == max(self.versions(), default=0):
                self.files.rename(f"{self.base}/_commits/{int(number):020d}.json", f"{self.base}/_commits/broken-{number}-{uuid.uuid4().hex}")
                gone.append(f"commit {number}")
        if problems := self.verify():
            raise CorruptionError("; ".join(problems))
        return gone

    def backup(self, target: str) -> dict:
        """A copy with a manifest of the commits' checksums, written last. Tables are copied by the executors."""
        version, target = self.version, target.rstrip("/")
        commits = {v: self.commit_record(v) for v in self.versions() if v <= version}
        self._copy_tables(self.base, target, [f"{r['path']}/{name}" for r in commits.values() for name in PARTS])
        for v in self._snapshots():
            self._copy_snapshot(self.base, target, v)
        for v in commits:
            self.files.write(f"{target}/_commits/{v:020d}.json", self.files.read(f"{self.base}/_commits/{v:020d}.json"))
        manifest = {"version": version, "commits": {str(v): zlib.crc32(self.files.read(f"{self.base}/_commits/{v:020d}.json")) for v in commits}}
        self.files.write(f"{target}/manifest.json", json.dumps(manifest).encode())
        return manifest

    def _copy_tables(self, source: str, target: str, tables: list[str]) -> None:
        """Table by table, each with as many tasks as it has files; rows stay in their order within a file."""
        for table in tables:
            self.spark.read.parquet(f"{source}/{table}").write.parquet(f"{target}/{table}")

    def _copy_snapshot(self, source: str, target: str, version: int) -> None:
        manifest = self.files.read(f"{source}/snapshots/{version}/manifest.json")
        self._copy_tables(source, target, [f"snapshots/{version}/{t}" for t in json.loads(manifest)["rows"]])
        self.files.write(f"{target}/snapshots/{version}/manifest.json", manifest)

    @staticmethod
    def restore(spark: SparkSession, source: str, base: str, version: int | None = None) -> Store:
        """Checks a backup, copies it next to base, and renames it there; with a version, without what came after."""
        files, source, base = Files(spark), source.rstrip("/"), base.rstrip("/")
        manifest = json.loads(files.read(f"{source}/manifest.json"))
        for v, crc in manifest["commits"].items():
            if zlib.crc32(files.read(f"{source}/_commits/{int(v):020d}.json")) != crc:
                raise CorruptionError(f"backup: commit {v} was changed")
        if problems := Store(spark, source).verify():
            raise CorruptionError("backup: " + "; ".join(problems))
        if files.exists(base):
            raise ConflictError(f"{base} exists")
        version = manifest["version"] if version is None else version
        if not 0 <= version <= manifest["version"]:
            raise NotFoundError(f"version {version}")
        staged, from_ = f"{base}.restore-{uuid.uuid4().hex}", Store(spark, source)
        commits = {v: from_.commit_record(v) for v in from_.versions() if v <= version}
        from_._copy_tables(source, staged, [f"{r['path']}/{name}" for r in commits.values() for name in PARTS])
        for v in from_._snapshots():
            if v <= version:
                from_._copy_snapshot(source, staged, v)
        for v in commits:
            files.write(f"{staged}/_commits/{v:020d}.json", files.read(f"{source}/_commits/{v:020d}.json"))
        files.make(f"{staged}/_commits")
        files.rename(staged, base)
        restored = Store(spark, base)
        if restored.version != version:
            raise NotFoundError(f"version {version} is older than the oldest snapshot")
        return restored

    def begin(self) -> Transaction:
        return Transaction(self)


class Transaction:
    """Reads its start version under its own staged operations; commits only if none of the ids it touches has changed
    since. The last operation on an id holds, and each is checked when it is staged; a failing one leaves the session as it was."""

    def __init__(self, store: Store):
        self.store, self.started, self.id = store, store.version, f"tx_{uuid.uuid4().hex}"
        self._base = store.view(self.started)
        self._nodes: dict[str, dict | None] = {}
        self._edges: dict[str, dict | None] = {}
        self.state = "open"

    def _open(self) -> None:
        if self.state != "open":
            raise ConflictError(f"the transaction is {self.state}")

    def upsert_node(self, record: dict) -> None:
        self._open()
        check_metadata(record["properties"])
        self._nodes[record["id"]] = record

    def upsert_edge(self, record: dict) -> None:
        self._open()
        ends = (record["source"], record["target"])
        if namespace_of(ends[0]) != namespace_of(ends[1]):
            raise ValidationError(f"edge {record['id']} crosses namespaces")
        for i in ends:
            if self._nodes[i] is None if i in self._nodes else self._base.nodes.where(F.col("id") == i).isEmpty():
                raise ValidationError(f"edge {record['id']}: no node {i}")
        self._edges[record["id"]] = record

    def delete_node(self, identifier: str) -> None:
        self._open()
        self._nodes[identifier] = None
        for i, r in list(self._edges.items()):
            if r is not None and identifier in (r["source"], r["target"]):
                self._edges[i] = None
        at = self._base.edges.where((F.col("source") == identifier) | (F.col("target") == identifier)).select("id")
        for r in at.toLocalIterator():
            self._edges.setdefault(r["id"], None)

    def delete_edge(self, identifier: str) -> None:
        self._open()
        self._edges[identifier] = None

    def view(self) -> GraphView:
        self._open()
        spark, split = self.store.spark, lambda m: ([r for r in m.values() if r is not None], [i for i, r in m.items() if r is None])
        (nodes, gone), (edges, cut) = split(self._nodes), split(self._edges)
        return self._base.overlay(nodes_frame(spark, nodes), edges_frame(spark, edges), _ids(spark, gone), _ids(spark, cut))

    def summary(self) -> dict:
        return {"id": self.id, "started_at": self.started, "state": self.state, "nodes": len(self._nodes), "edges": len(self._edges)}

    def commit(self) -> int:
        self._open()
        if not self._nodes and not self._edges:
            raise ValidationError("the transaction is empty")
        batch = Batch([r for r in self._nodes.values() if r], [r for r in self._edges.values() if r], [i for i, r in self._nodes.items() if r is None], [i for i, r in self._edges.items() if r is None])
        while True:
            # what is checked for conflicts is what is published on: a commit after that makes the write fail, and all is checked again
            seen = self.store.version
            self._conflicts(seen)
            try:
                version = self.store.write(batch, seen)
                break
            except ConflictError:
                if self.store.version == seen:
                    raise
        self.state = "committed"
        return version

    def _conflicts(self, seen: int) -> None:
        """Against the commits after the start, up to the version seen."""
        spark, store = self.store.spark, self.store
        for ids, parts in ((self._nodes, PARTS[::2]), (self._edges, PARTS[1::2])):
            touched = _ids(spark, ids)
            if store.pruned() > self.started:
                raise ConflictError("commits since the transaction began were pruned")
            for v in store.versions():
                if self.started < v <= seen and ids:
                    path = store.commit_record(v)["path"]
                    for part in parts:
                        rows = spark.read.schema("id string").parquet(f"{store.base}/{path}/{part}")
                        if both := rows.join(F.broadcast(touched), "id", "left_semi").head(1):
                            raise ConflictError(f"{both[0]['id']} was changed by version {v}")

    def rollback(self) -> None:
        self._open()
        self.state = "rolled back"
