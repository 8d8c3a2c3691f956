"""What surrounds the queries: roles, rate limits, audit, metrics, topology, maintenance, and the calls that enforce them."""

from __future__ import annotations

import hmac
import json
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import MaintenanceBudget, VectorConfig
from .errors import AccessError, ConflictError, EngramError, LimitError, NotFoundError, ValidationError
from .functions.scores import latency_band
from .model import EDGE_RECORD, NODE_RECORD, GraphView, check_id
from .plans.requests import execute, stream
from .sources.files import Files
from .sources.store import Batch, Store, Transaction

#: Which actions each role may take.
ROLES = {"reader": {"read"}, "writer": {"read", "write"}, "admin": {"read", "write", "admin"}}


@dataclass(frozen=True)
class Principal:
    name: str
    role: str

    def may(self, action: str) -> bool:
        return action in ROLES[self.role]


class Keys:
    def __init__(self, keys: dict[str, Principal]):
        if any(p.role not in ROLES for p in keys.values()):
            raise ValidationError("unknown role")
        self._keys = keys

    def principal(self, key: str) -> Principal:
        """Every key is compared, in constant time."""
        found = None
        for known, who in self._keys.items():
            if hmac.compare_digest(known.encode(), key.encode()):
                found = who
        if found is None:
            raise AccessError("unknown key")
        return found


class TokenBucket:
    def __init__(self, burst: int = 1_000, rate: float = 100.0, clock=time.monotonic):
        self.burst, self.rate, self.clock, self.left, self.at = burst, rate, clock, float(burst), clock()

    def take(self) -> bool:
        now = self.clock()
        self.left, self.at = min(self.burst, self.left + (now - self.at) * self.rate), now
        if self.left < 1:
            return False
        self.left -= 1
        return True


EVENT = "at_ms long, actor string, action string, target string, outcome string, ms double"


class AuditLog:
    """Events in files of JSON lines under folder, segment of them a file; the newest retain are kept, whole files at a time. Without a
    folder they are in memory only."""

    def __init__(self, spark: SparkSession, folder: str | None = None, retain: int = 10_000, segment: int = 100):
        self.spark, self.folder, self.retain, self.segment = spark, folder and folder.rstrip("/"), retain, segment
        self.files, self._open = Files(spark), deque(maxlen=None if folder else retain)

    def append(self, actor: str, action: str, target: str = "", outcome: str = "ok", ms: float = 0.0) -> None:
        self._open.append({"at_ms": int(time.time() * 1000), "actor": actor, "action": action, "target": target, "outcome": outcome, "ms": float(ms)})
        if self.folder and len(self._open) >= self.segment:
            self.flush()

    def flush(self) -> None:
        if not self.folder or not self._open:
            return
        name = f"{time.time_ns():020d}-{len(self._open):06d}-{uuid.uuid4().hex}.json"
        self.files.write(f"{self.folder}/{name}", "\n".join(map(json.dumps, self._open)).encode())
        self._open.clear()
        there = self._segments()
        kept = 0
        for n in reversed(there):
            if kept >= self.retain:
                self.files.delete(f"{self.folder}/{n}")
            kept += int(n.split("-")[1])

    def _segments(self) -> list[str]:
        return [n for n in self.files.names(self.folder) if n.endswith(".json")] if self.folder else []

    def export(self, last: int) -> list[str]:
        """The newest events as JSON lines, the oldest of them first."""
        out = [json.dumps(e) for e in self._open]
        for n in reversed(self._segments()):
            if len(out) >= last:
                break
            out = self.files.read(f"{self.folder}/{n}").decode().splitlines() + out
        return out[-last:] if last > 0 else []

    def frame(self) -> DataFrame:
        self.flush()
        if self._segments():
            return self.spark.read.schema(EVENT).json(self.folder)
        return self.spark.createDataFrame([tuple(e.values()) for e in self._open], EVENT)


def latency_histogram(events: DataFrame) -> DataFrame:
    """action, band, n, total_ms."""
    return events.groupBy("action", latency_band(F.col("ms")).alias("band")).agg(F.count("*").alias("n"), F.sum("ms").alias("total_ms"))


def prometheus(histogram: DataFrame) -> str:
    return "".join(f'engram_latency_count{{action="{r["action"]}",band="{r["band"]}"}} {r["n"]}\n' for r in sorted(histogram.collect()))


def within_budget(view: GraphView, budget: MaintenanceBudget = MaintenanceBudget()) -> dict:
    counts = {"nodes": view.nodes.count(), "edges": view.edges.count()}
    if counts["nodes"] > budget.max_nodes or counts["edges"] > budget.max_edges:
        raise ValidationError(f"maintenance is over its budget: {counts}")
    return counts


@dataclass
class Member:
    name: str
    role: str = "follower"
    applied: int = 0
    healthy: bool = True


@dataclass
class Cluster:
    """Who leads and how far the others are; promotion is by hand and raises the term. save() and load() keep it in a file a change."""

    term: int = 1
    members: dict[str, Member] = field(default_factory=dict)

    def join(self, name: str, role: str = "follower") -> None:
        if role == "leader" and self.leader() is not None:
            raise ConflictError("there is a leader")
        self.members[name] = Member(name, role)

    def leader(self) -> Member | None:
        return next((m for m in self.members.values() if m.role == "leader"), None)

    def _member(self, name: str) -> Member:
        if name not in self.members:
            raise NotFoundError(name)
        return self.members[name]

    def acknowledge(self, name: str, version: int) -> None:
        member = self._member(name)
        member.applied = max(member.applied, version)

    def report(self, name: str, healthy: bool) -> None:
        self._member(name).healthy = healthy

    def promote(self, name: str) -> int:
        if not self._member(name).healthy:
            raise ConflictError(f"{name} is not healthy")
        for m in self.members.values():
            m.role = "leader" if m.name == name else "follower"
        self.term += 1
        return self.term

    def topology(self) -> list[dict]:
        """Lag is behind the leader; where there is none, behind the farthest member."""
        leader = self.leader()
        head = leader.applied if leader else max((x.applied for x in self.members.values()), default=0)
        return [asdict(m) | {"lag": max(0, head - m.applied)} for m in self.members.values()]

    def save(self, files: Files, folder: str) -> None:
        n = len(files.names(folder))
        files.write(f"{folder}/{n:020d}.json", json.dumps({"term": self.term, "members": [asdict(m) for m in self.members.values()]}).encode())

    @staticmethod
    def load(files: Files, folder: str) -> Cluster:
        names = [n for n in files.names(folder) if n.endswith(".json")]
        if not names:
            return Cluster()
        about = json.loads(files.read(f"{folder}/{names[-1]}"))
        return Cluster(about["term"], {m["name"]: Member(**m) for m in about["members"]})


class Service:
    """The calls of a server on one store, without the server. Each call names its key: the key's role must allow the action, its
    own bucket must have a token, and what it did, how it ended and how long it took goes to the audit log."""

    def __init__(self, store: Store, keys: Keys, budget: MaintenanceBudget = MaintenanceBudget(), settings: VectorConfig = VectorConfig(), burst: int = 1_000, rate: float = 100.0, clock=time.monotonic, retain: int = 10_000):
        self.store, self.keys, self.budget, self.settings = store, keys, budget, settings
        self.audit = AuditLog(store.spark, f"{store.base}/audit", retain)
        self._bucket = lambda: TokenBucket(burst, rate, clock)
        self._buckets: dict[str, TokenBucket] = {}
        self._transactions: dict[str, Transaction] = {}
        self._cluster_folder = f"{store.base}/cluster"

    @contextmanager
    def _call(self, key: str, action: str, name: str, target: str = ""):
        who, began, outcome = self.keys.principal(key), time.perf_counter(), "ok"
        try:
            if not self._buckets.setdefault(key, self._bucket()).take():
                raise LimitError("too many calls")
            if not who.may(action):
                raise AccessError(f"{who.role} may not {action}")
            yield who
        except EngramError as e:
            outcome = type(e).__name__
            raise
        finally:
            self.audit.append(who.name, name, target, outcome, (time.perf_counter() - began) * 1000)

    # records

    def _one(self, frame: DataFrame, identifier: str) -> dict:
        rows = frame.where(F.col("id") == identifier).head(1)
        if not rows:
            raise NotFoundError(identifier)
        return rows[0].asDict(recursive=True)

    def get_node(self, key: str, identifier: str) -> dict:
        with self._call(key, "read", "get_node", identifier):
            return self._one(self.store.view().nodes.select(*NODE_RECORD.names), check_id(identifier))

    def get_edge(self, key: str, identifier: str) -> dict:
        with self._call(key, "read", "get_edge", identifier):
            return self._one(self.store.view().edges.select(*EDGE_RECORD.names), check_id(identifier))

    def create_node(self, key: str, record: dict) -> int:
        with self._call(key, "write", "create_node", record["id"]):
            return self.store.write(Batch(nodes=[record]))

    def create_edge(self, key: str, record: dict) -> int:
        with self._call(key, "write", "create_edge", record["id"]):
            return self.store.write(Batch(edges=[record]))

    @staticmethod
    def _same(identifier: str, record: dict) -> None:
        if identifier != record["id"]:
            raise ValidationError(f"the record is {record['id']}, not {identifier}")

    def put_node(self, key: str, identifier: str, record: dict) -> int:
        with self._call(key, "write", "put_node", identifier):
            self._same(identifier, record)
            return self.store.write(Batch(nodes=[record]))

    def put_edge(self, key: str, identifier: str, record: dict) -> int:
        with self._call(key, "write", "put_edge", identifier):
            self._same(identifier, record)
            return self.store.write(Batch(edges=[record]))

    def delete_node(self, key: str, identifier: str) -> int:
        with self._call(key, "write", "delete_node", identifier):
            self._one(self.store.view().nodes.select("id"), check_id(identifier))
            return self.store.write(Batch(node_deletes=[identifier]))

    def delete_edge(self, key: str, identifier: str) -> int:
        with self._call(key, "write", "delete_edge", identifier):
            self._one(self.store.view().edges.select("id"), check_id(identifier))
            return self.store.write(Batch(edge_deletes=[identifier]))

    # queries

    def _view(self, transaction: str | None) -> GraphView:
        return self.store.view() if transaction is None else self._transaction(transaction).view()

    def query(self, key: str, request: dict, transaction: str | None = None) -> list[tuple[str, dict]]:
        """The items of a request's answer, within the response budget; with a transaction, as it sees the graph."""
        with self._call(key, "read", f"query:{next(iter(request), '')}", transaction or ""):
            return execute(self._view(transaction), request, self.settings).checked()

    def stream(self, key: str, request: dict, transaction: str | None = None) -> Iterator[str]:
        with self._call(key, "read", f"stream:{next(iter(request), '')}", transaction or ""):
            yield from stream(execute(self._view(transaction), request, self.settings))

    # transactions

    def _transaction(self, identifier: str) -> Transaction:
        if identifier not in self._transactions:
            raise NotFoundError(identifier)
        return self._transactions[identifier]

    def begin(self, key: str) -> str:
        with self._call(key, "write", "begin"):
            made = self.store.begin()
            self._transactions[made.id] = made
            return made.id

    def transactions(self, key: str) -> list[dict]:
        with self._call(key, "read", "transactions"):
            return [t.summary() for t in self._transactions.values()]

    def transaction(self, key: str, identifier: str) -> dict:
        with self._call(key, "read", "transaction", identifier):
            return self._transaction(identifier).summary()

    def stage(self, key: str, identifier: str, operation: str, content: dict | str) -> dict:
        """operation: upsert_node, upsert_edge (a record), delete_node, delete_edge (an id)."""
        with self._call(key, "write", f"stage:{operation}", identifier):
            if operation not in ("upsert_node", "upsert_edge", "delete_node", "delete_edge"):
                raise ValidationError(f"unknown operation: {operation}")
            held = self._transaction(identifier)
            getattr(held, operation)(content)
            return held.summary()

    def commit(self, key: str, identifier: str) -> int:
        with self._call(key, "write", "commit", identifier):
            version = self._transaction(identifier).commit()
            del self._transactions[identifier]
            return version

    def rollback(self, key: str, identifier: str) -> None:
        with self._call(key, "write", "rollback", identifier):
            self._transaction(identifier).rollback()
            del self._transactions[identifier]

    # upkeep

    def maintenance(self, key: str) -> dict:
        """Sizes against the budget, and what there is to fold."""
        with self._call(key, "admin", "maintenance"):
            store, view = self.store, self.store.view()
            counts = {"nodes": view.nodes.count(), "edges": view.edges.count()}
            fits = counts["nodes"] <= self.budget.max_nodes and counts["edges"] <= self.budget.max_edges
            return counts | {"version": store.version, "commits": len(store.versions()), "pruned": store.pruned(), "within_budget": fits}

    def _upkeep(self, key: str, name: str, run: Callable[[], object], target: str = ""):
        with self._call(key, "admin", name, target):
            within_budget(self.store.view(), self.budget)
            return run()

    def compact(self, key: str) -> int:
        return self._upkeep(key, "compact", self.store.compact)

    def prune(self, key: str, keep: int = 0) -> list[int]:
        return self._upkeep(key, "prune", lambda: self.store.prune(keep))

    def rebuild_indexes(self, key: str) -> list[str]:
        return self._upkeep(key, "rebuild_indexes", lambda: self.store.rebuild_indexes(self.settings))

    def backup(self, key: str, target: str) -> dict:
        return self._upkeep(key, "backup", lambda: self.store.backup(target), target)

    def integrity(self, key: str) -> list[str]:
        with self._call(key, "admin", "integrity"):
            return self.store.verify()

    def repair(self, key: str) -> list[str]:
        with self._call(key, "admin", "repair"):
            return self.store.repair()

    def restore(self, key: str, source: str, base: str, version: int | None = None) -> Store:
        with self._call(key, "admin", "restore", source):
            return Store.restore(self.store.spark, source, base, version)

    def audit_export(self, key: str, last: int = 100) -> list[str]:
        with self._call(key, "admin", "audit"):
            return self.audit.export(last)

    def metrics(self, key: str) -> str:
        with self._call(key, "admin", "metrics"):
            return prometheus(latency_histogram(self.audit.frame()))

    # members

    def _cluster(self, key: str, name: str, change: Callable[[Cluster], object], target: str = ""):
        with self._call(key, "admin", name, target):
            cluster = Cluster.load(self.store.files, self._cluster_folder)
            out = change(cluster)
            cluster.save(self.store.files, self._cluster_folder)
            return out

    def join(self, key: str, name: str, role: str = "follower") -> None:
        self._cluster(key, "join", lambda c: c.join(name, role), name)

    def acknowledge(self, key: str, name: str, version: int) -> None:
        self._cluster(key, "acknowledge", lambda c: c.acknowledge(name, version), name)

    def report(self, key: str, name: str, healthy: bool) -> None:
        self._cluster(key, "report", lambda c: c.report(name, healthy), name)

    def promote(self, key: str, name: str) -> int:
        return self._cluster(key, "promote", lambda c: c.promote(name), name)

    def replication(self, key: str) -> dict:
        """The leader's version and term, and each member's lag."""
        with self._call(key, "admin", "replication"):
            cluster = Cluster.load(self.store.files, self._cluster_folder)
            return {"version": self.store.version, "term": cluster.term, "members": cluster.topology()}
