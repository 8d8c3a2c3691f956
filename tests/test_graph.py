"""Operators on small graphs with known answers."""

import json
import random
import threading
import zlib

import pytest
from pyspark.sql import functions as F

from engramspark import config
from engramspark.__main__ import main
from engramspark.errors import AccessError, ConflictError, CorruptionError, LimitError, NotFoundError, SerializationError, ValidationError
from engramspark.functions import scores
from engramspark.functions.stats import nearest_rank
from engramspark.model import GraphView, check_id, edge, edges_frame, namespace_of, node, nodes_frame
from engramspark.operators import consolidation, lookup, paths, ranking, traversal, vectors
from engramspark.operators.traversal import BOTH, INCOMING, OUTGOING, Constraints
from engramspark.plans import predicates as P
from engramspark.plans import requests as R
from engramspark.service import AuditLog, Cluster, Keys, Principal, Service, TokenBucket, latency_histogram, prometheus, within_budget
from engramspark.sources import jsonl, legacy
from engramspark.sources.files import Files
from engramspark.sources.store import Batch, Store
from engramspark.streaming.replication import Follower

DAY = 86_400_000


def ids(frame):
    return [r["id"] for r in frame.select("id").collect()]


@pytest.fixture(scope="module")
def chain(spark):
    nodes = [node(i, "memory", {"timestamp": t, "importance": imp, "confidence": conf}, {"default": v}) for i, t, imp, conf, v in (("a", 1000, 0.9, 0.8, [1, 0]), ("b", 1100, 0.6, 0.7, [0.8, 0.2]), ("c", 4_000_000, 0.2, 0.4, [0, 1]))]
    return GraphView.of(spark, nodes, [edge("ab", "a", "b", "relates_to"), edge("bc", "b", "c", "relates_to")])


def test_neighbors_traverse_and_path(chain):
    nodes, edges = traversal.neighbors(chain, "a", OUTGOING)
    assert ids(nodes) == ["b"] and ids(edges) == ["ab"]
    nodes, edges, truncated = traversal.traverse(chain, "a", OUTGOING, 2, constraints=Constraints.of("relates_to", node_labels=["memory"]))
    assert {r["id"]: r["depth"] for r in nodes.collect()} == {"a": 0, "b": 1, "c": 2} and set(ids(edges)) == {"ab", "bc"} and not truncated
    found = paths.shortest_path(chain, "a", "c")
    assert found.path.node_ids == ("a", "b", "c") and found.path.edge_ids == ("ab", "bc") and found.path.hop_count == 2
    assert paths.shortest_path(chain, "c", "a").path is None and paths.shortest_path(chain, "c", "a", INCOMING).path.edge_ids == ("bc", "ab")
    assert paths.shortest_path(chain, "a", "a").path.hop_count == 0 and paths.shortest_path(chain, "a", "none").path is None
    assert [k for k, _ in R.execute(chain, {"Traverse": {"start_node_id": "a", "direction": "Outgoing", "max_hops": 1}}).items()] == ["node", "node", "edge"]
    assert ids(traversal.traverse(chain, "none")[0]) == []


def test_time_and_ranking(chain):
    assert ids(lookup.in_time_range(chain, "timestamp", 900, 2000, 10)) == ["a", "b"]
    assert ids(vectors.search(chain, [1.0, 0.0], 2))[0] == "a"
    result = R.execute(chain, {"RankedRetrieval": {"query_vector": [1.0, 0.0], "reference_node_id": "a", "from_epoch_ms": 900, "to_epoch_ms": 10_000, "limit": 3, "now_epoch_ms": 1200}})
    rows = result.ranked.collect()
    assert [r["id"] for r in rows] == ["a", "b"] and result.profile == "v1-default" and len(result.checked()) == 2
    assert rows[0]["structural_score"] == 1 and rows[1]["structural_score"] == 0.5 and rows[0]["semantic_score"] == 1
    week = scores.WEEK_MS
    assert rows[0]["score"] == pytest.approx(0.3 + 0.3 + 0.15 * week / (week + 200) + 0.15 * 0.9 + 0.1 * 0.8)


def test_missing_signals(spark):
    view = GraphView.of(spark, [node("x", "t"), node("y", "t", {"importance": 7, "confidence": -1.0, "timestamp": 99})])
    rows = {r["id"]: r for r in ranking.ranked(view, 5, 50, reference_node_id="x").collect()}
    assert (rows["x"]["temporal_score"], rows["x"]["importance_score"], rows["x"]["confidence_score"]) == (0, 0.5, 0.5)
    assert (rows["y"]["temporal_score"], rows["y"]["importance_score"], rows["y"]["confidence_score"]) == (1, 1, 0)


def test_cosine_and_decay(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, 0.0], [1.0])], "a array<float>, b array<float>, c array<float>, z array<float>, s array<float>")
    got = row.select(*(scores.cosine(F.col(c), [1.0, 0.0]).alias(c) for c in "abczs")).first()
    assert tuple(got) == (1.0, 0.5, 0.0, None, None)
    assert spark.range(1).select(scores.recency(F.lit(0), 7 * DAY)).first()[0] == 0.5


def test_filters(spark):
    view = GraphView.of(spark, [node("node_a", "user", {"score": 95, "unique_key": "alice", "tags": ["x", "y"], "ok": True}), node("node_b", "user", {"score": 80.5, "unique_key": "bob"}), node("node_c", "service", {"score": 99, "label": "user", "nan": float("nan")}), node("node_d", "user")])
    run = lambda p, label=None: ids(lookup.filtered(view, p, label))
    assert run(P.all_of(P.eq("label", "user"), P.gt("score", 90))) == ["node_a", "node_c"]
    assert run(P.gt("score", 90), "user") == ["node_a"]
    assert run(P.any_of(P.gt("score", 90), P.eq("unique_key", "bob"))) == ["node_a", "node_b", "node_c"]
    assert run(P.eq("tags", ["x", "y"])) == ["node_a"] and run(P.eq("ok", True)) == ["node_a"] and run(P.eq("score", 95.0)) == ["node_a"]
    assert run(P.eq("score", "95")) == [] and run(P.gte("nan", -1)) == [] and run(P.lte("score", 80.5)) == ["node_b"] and run(P.eq("id", "node_d")) == ["node_d"]
    assert P.Predicate.parse({"op": "and", "conditions": [{"op": "gt", "field": "score", "value": {"kind": "Integer", "value": 90}}, {"op": "or", "conditions": [{"op": "eq", "field": "label", "value": "user"}]}]}).validate().leaves() == 2
    for bad in (P.all_of(), P.eq(" ", 1), P.gt("score", "x"), P.Predicate("ne", "a", 1)):
        with pytest.raises(ValidationError):
            bad.validate()
    with pytest.raises(ValidationError):
        lookup.filtered(view, P.eq("id", "x"), " ")


def test_limits(chain):
    for call in (lambda: config.result_limit(0), lambda: config.result_limit(1001), lambda: config.timeout_ms(0), lambda: config.timeout_ms(30_001), lambda: config.depth(0)):
        with pytest.raises(ValidationError):
            call()
    for request in ({"TimeRange": {"field": "timestamp", "from_epoch_ms": 2, "to_epoch_ms": 1, "limit": 1}}, {"RankedRetrieval": {"limit": 1, "now_epoch_ms": 0}}, {"RankedRetrieval": {"limit": 1, "now_epoch_ms": 0, "reference_node_id": "a", "retrieval_profile": "x"}}, {"VectorSearch": {"query_vector": [], "limit": 1}}, {"Nothing": {}}, {"SearchByLabel": {"label": "x", "offset": 1}}, {"SearchByLabel": {"label": " "}}):
        with pytest.raises(ValidationError):
            R.execute(chain, request)
    assert R.parse({"FilterNodes": {"where": {"op": "gt", "field": "score", "value": 1}, "label": "m", "limit": 7}}).plan() == R.Plan("FilterScan", (("limit", R.wrap(7)), ("label", R.wrap("m")), ("predicate_count", R.wrap(1))))


def test_ties_go_by_id(spark):
    view = GraphView.of(spark, [node(i, "t", vectors={"default": v}) for i, v in (("d", [0.2, 1]), ("c", [1, 1]), ("b", [1, 0.1]), ("a", [1, 1]))])
    assert ids(vectors.search(view, [1.0, 0.0], 3)) == ["b", "a", "c"]


def test_self_loop_and_parallel_edges(spark):
    view = GraphView.of(spark, [node("x", "t"), node("y", "t")], [edge("loop", "x", "x", "r"), edge("p1", "x", "y", "r"), edge("p2", "x", "y", "s"), edge("p3", "y", "x", "r")])
    nodes, edges = traversal.neighbors(view, "x", BOTH)
    assert sorted(ids(edges)) == ["loop", "p1", "p2", "p3"] and sorted(ids(nodes)) == ["x", "y"]
    assert ids(traversal.neighbors(view, "x", BOTH, limit=2)[1]) == ["loop", "p1"]
    assert ids(traversal.neighbors(view, "x", OUTGOING, "s")[1]) == ["p2"]


def test_caps_take_the_first_by_rank(spark):
    view = GraphView.of(spark, [node(f"n{i}", "t") for i in range(30)], [edge(f"e{i:02d}", "n0", f"n{i}", "r") for i in range(1, 20)] + [edge(f"f{i:02d}", "n1", f"n{i}", "r") for i in range(15, 30)])
    found = traversal.traverse_ids(view, "n0", OUTGOING, 3, 5, None, Constraints())
    assert [i for i, _ in found.nodes] == ["n0", "n1", "n2", "n3", "n4"] and found.edges == ["e01", "e02", "e03", "e04", "e05"] and found.truncated
    assert paths.shortest_path(view, "n0", "n29", limit=3).truncated
    assert R.execute(view, R.Traverse("n0", OUTGOING, max_hops=3, limit=5)).truncated and not R.execute(view, R.Traverse("n0", OUTGOING, max_hops=3, limit=100)).truncated


def test_large_hops_give_what_small_ones_do(spark, monkeypatch):
    """Hops beyond what the driver takes at once are cut or joined on the executors."""
    rng = random.Random(8)
    links = [(f"e{i:03d}", f"v{rng.randrange(30)}", f"v{rng.randrange(30)}") for i in range(90)]
    view = GraphView.of(spark, [node(f"v{i}", "t") for i in range(30)], [edge(i, s, t, "r") for i, s, t in links])

    def everything():
        walk = [traversal.traverse_ids(view, "v0", BOTH, 3, limit, None, Constraints()) for limit in (1000, 12)]
        path = [paths.shortest_path(view, "v0", f"v{i}", OUTGOING, limit=1000).path for i in (5, 11, 17)]
        return walk, path, sorted(map(tuple, traversal.distances(view, "v0", 2).select("id", "distance").collect()))

    small = everything()
    monkeypatch.setattr(traversal, "HOP_ROWS", 2)
    monkeypatch.setattr(paths, "HOP_ROWS", 2)
    large = everything()
    assert small[0][0] == large[0][0] and small[0][1] == large[0][1] and small[2] == large[2]
    assert [p and p.hop_count for p in small[1]] == [p and p.hop_count for p in large[1]]


def test_random_graphs_against_plain_search(spark):
    rng = random.Random(5)
    for _ in range(3):
        n = 14
        links = [(f"e{i:02d}", f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for i in range(20)]
        view = GraphView.of(spark, [node(f"v{i}", "even" if i % 2 == 0 else "odd") for i in range(n)], [edge(i, s, t, "r") for i, s, t in links])
        out = {f"v{i}": {t for _, s, t in links if s == f"v{i}"} for i in range(n)}
        depth, front = {"v0": 0}, ["v0"]
        while front:
            front = [t for s in front for t in out[s] if t not in depth and not depth.__setitem__(t, depth[s] + 1)]
        nodes, edges, _ = traversal.traverse(view, "v0", OUTGOING, 3, 1000)
        assert {r["id"]: r["depth"] for r in nodes.collect()} == {k: d for k, d in depth.items() if d <= 3}
        assert set(ids(edges)) == {i for i, s, _ in links if depth.get(s, 9) <= 2}
        starts = spark.createDataFrame([("v0",), ("v1",), ("gone",)], "id string")
        assert {r["id"]: r["depth"] for r in traversal.reachable(view, starts, 3).where("start = 'v0'").collect()} == {k: d for k, d in depth.items() if d <= 3}
        assert {r["id"] for r in traversal.traversed_edges(view, starts, 3).where("start = 'v0'").collect()} == set(ids(edges))
        for target in ("v3", "v8"):
            found = paths.shortest_path(view, "v0", target, limit=1000).path
            assert (found.hop_count if found else None) == depth.get(target)
            if found:
                by = {i: (s, t) for i, s, t in links}
                assert all(by[e] == (a, b) for e, a, b in zip(found.edge_ids, found.node_ids, found.node_ids[1:]))


def test_endpoints_are_exempt_from_labels(spark):
    view = GraphView.of(spark, [node("a", "x"), node("m", "mid"), node("o", "other"), node("z", "y")], [edge("1", "a", "o", "r"), edge("2", "o", "z", "r"), edge("3", "a", "m", "r"), edge("4", "m", "z", "r")])
    assert paths.shortest_path(view, "a", "z", constraints=Constraints.of(node_labels=["mid"])).path.node_ids == ("a", "m", "z")
    assert paths.shortest_path(view, "a", "z", constraints=Constraints.of(node_labels=["none"])).path is None


def test_duplicate_unique_keys(spark):
    view = GraphView.of(spark, [node("a", "t", {"unique_key": "k"}), node("b", "u", {"unique_key": "k"}), node("c", "t", {"unique_key": 7})])
    assert ids(lookup.by_unique_key(view, "k")) == ["b"] and ids(lookup.by_unique_key(view, "7")) == []


def test_records():
    assert namespace_of("tenant_a:node_1") == "tenant_a" and namespace_of("x") is None
    for good in ("node_1", "edge:1", "tx_1"):
        check_id(good)
    for bad in ("bad id", "", "é", "a\n"):
        with pytest.raises(ValidationError):
            check_id(bad)
    for props in ({"embedding": [0.1]}, {"timestamp": "x"}, {"importance": "high"}):
        with pytest.raises(ValidationError):
            node("a", "t", props)
    with pytest.raises(ValidationError):
        node("a", " ")


def test_promoted_columns(spark):
    rows = nodes_frame(spark, [node("t:a", "m", {"timestamp": 123.9, "importance": 0.8, "confidence": 1, "unique_key": "u"}, {"default": [0.1, 0.2]}), node("b", "m", {"timestamp": float("nan")}), node("c", "m", {"timestamp": 1e300}), node("d", "m", {"timestamp": -1e300})]).collect()
    assert [(r.namespace, r.unique_key, r.timestamp_ms, r.importance, r.confidence) for r in rows[:1]] == [("t", "u", 123, 0.8, 1.0)]
    assert [r.timestamp_ms for r in rows[1:]] == [0, 2**63 - 1, -(2**63)]


def test_consolidation(spark):
    now = 40 * DAY
    view = GraphView.of(spark, [node("t:a", "M", {"unique_key": "k", "timestamp": 1000}), node("t:b", "M", {"unique_key": "k", "timestamp": 1100, "importance": 0.8}), node("t:c", "M")], [edge("t:e", "t:a", "t:b", "r")])
    events = consolidation.analyse(view, now)
    assert sorted((r.action, r.target, tuple(r.related)) for r in events.collect()) == [("Archive", "t:a", ()), ("Archive", "t:b", ()), ("Demote", "t:c", ()), ("Merge", "t:a", ("t:b",))]
    after, before = consolidation.apply(view, events)
    rows = {r["id"]: r for r in after.nodes.collect()}
    assert rows["t:b"]["properties"]["merged_into"]["s"] == "t:a" and rows["t:b"]["properties"]["archived"]["b"] and rows["t:c"]["importance"] == 0.25
    undone = after.overlay(nodes=before)
    assert {r["id"]: r["properties"].keys() for r in undone.nodes.collect()} == {r["id"]: r["properties"].keys() for r in view.nodes.collect()}


def test_approximate_search(spark, tmp_path):
    rng = random.Random(1)
    view = GraphView.of(spark, [node(f"n{i:03d}", "even" if i % 2 == 0 else "odd", vectors={"default": [rng.gauss(0, 1) for _ in range(8)]}) for i in range(300)])
    settings = config.VectorConfig(exact_threshold=10, lists=8, probes=8)
    near = GraphView(view.nodes, view.edges, vector_index=vectors.build_index(view, f"{tmp_path}/ivf", settings=settings))
    q = [1.0] * 8
    assert ids(vectors.search(near, q, 20, settings=settings)) == ids(vectors.search(view, q, 20, settings=settings))
    assert ids(vectors.search(near, q, 5, "odd", settings=settings)) == ids(vectors.search(view, q, 5, "odd", settings=settings))
    few = config.VectorConfig(exact_threshold=10, lists=8, probes=2)
    report = vectors.quality(vectors.search(view, q, 20, settings=few), vectors.search(near, q, 20, settings=few)).first()
    assert 0 < report.overlap <= 1 and report.jaccard <= report.overlap
    assert vectors.search(near, [1.0, 2.0], 3, settings=settings).first()["score"] == 0


def test_approximate_search_loses_no_neighbour(spark, tmp_path):
    rng = random.Random(4)
    view = GraphView.of(spark, [node(f"n{i:03d}", "rare" if i % 50 == 0 else "usual", vectors={"default": [rng.gauss(0, 1) for _ in range(8)]}) for i in range(400)])
    settings = config.VectorConfig(exact_threshold=10, lists=16, probes=1, semantic_top_k=10)
    near = GraphView(view.nodes, view.edges, vector_index=vectors.build_index(view, f"{tmp_path}/ivf", settings=settings))
    for q in ([rng.gauss(0, 1) for _ in range(8)] for _ in range(3)):
        assert ids(vectors.search(near, q, 10, settings=settings)) == ids(vectors.search(view, q, 10, settings=settings))
        assert ids(vectors.search(near, q, 6, "rare", settings=settings)) == ids(vectors.search(view, q, 6, "rare", settings=settings))


def test_batched_search_equals_single(spark):
    rng = random.Random(2)
    rows = [(f"n{i}", [rng.gauss(0, 1) for _ in range(4)] if i % 9 else ([0.0] * 4 if i % 2 else [1.0])) for i in range(60)]
    view = GraphView.of(spark, [node(i, "t", vectors={"default": v}) for i, v in rows])
    queries = spark.createDataFrame(rows[1:6], "query_id string, vector array<float>")
    for block in (4096, 2):
        got = vectors.search_batch(vectors.space(view), queries, 7, block).collect()
        for name, q in rows[1:6]:
            own = sorted((r for r in got if r.query_id == name), key=lambda r: r["rank"])
            want = vectors.search(view, [float(x) for x in q], 7).collect()
            assert [r.id for r in own] == [r["id"] for r in want]
            assert [r.score for r in own] == pytest.approx([r["score"] for r in want], abs=1e-6)


def test_store_and_transactions(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    assert store.version == 0 and store.view().nodes.count() == 0
    assert store.write(Batch([node("a", "t", {"v": 1}), node("b", "t")], [edge("e", "a", "b", "r")])) == 1
    for bad in (Batch(), Batch(edges=[edge("x", "a", "none", "r")]), Batch([node("p:a", "t")], [edge("x", "a", "p:a", "r")])):
        with pytest.raises(ValidationError):
            store.write(bad)
    reader, other = store.begin(), store.begin()
    other.upsert_node(node("a", "t", {"v": 2}))
    assert other.commit() == 2
    assert lookup.by_id(reader.view(), "a").first()["properties"]["v"]["i"] == 1
    reader.upsert_node(node("a", "t", {"v": 3}))
    assert lookup.by_id(reader.view(), "a").first()["properties"]["v"]["i"] == 3
    with pytest.raises(ConflictError):
        reader.commit()
    reader.rollback()
    with pytest.raises(ConflictError):
        reader.delete_node("a")
    tx = store.begin()
    with pytest.raises(ValidationError):
        tx.upsert_edge(edge("bad", "a", "gone", "r"))
    tx.delete_node("a")
    assert ids(tx.view().edges) == []
    tx.upsert_node(node("a", "t", {"v": 4}))
    assert tx.commit() == 3
    assert ids(store.view().edges) == [] and sorted(ids(store.view().nodes)) == ["a", "b"]
    assert ids(store.view(1).edges) == ["e"] and lookup.by_id(store.view(1), "a").first()["properties"]["v"]["i"] == 1
    with pytest.raises(ValidationError):
        store.begin().commit()
    with pytest.raises(NotFoundError):
        store.view(9)
    assert store.compact() == 3 and store.write(Batch([node("c", "t")])) == 4 and store.verify() == []
    manifest = store.backup(f"{tmp_path}/backup")
    assert manifest["version"] == 4
    back = Store.restore(spark, f"{tmp_path}/backup", f"{tmp_path}/r", version=2)
    assert back.version == 2 and ids(back.view().edges) == ["e"]
    assert sorted(ids(Store.restore(spark, f"{tmp_path}/backup", f"{tmp_path}/r2").view().nodes)) == ["a", "b", "c"]
    commit = tmp_path / "backup/_commits/00000000000000000002.json"
    (tmp_path / "backup/_commits/.00000000000000000002.json.crc").unlink(missing_ok=True)
    commit.write_text(commit.read_text().replace('"term": 1', '"term": 9'))
    with pytest.raises(CorruptionError):
        Store.restore(spark, f"{tmp_path}/backup", f"{tmp_path}/r3")
    last = tmp_path / "s/_commits/00000000000000000004.json"
    (tmp_path / "s/_commits/.00000000000000000004.json.crc").unlink(missing_ok=True)
    last.write_text("{")
    assert store.verify() and store.repair() == ["commit 4"] and store.version == 3


def test_follower(spark, tmp_path):
    leader = Store(spark, f"{tmp_path}/l", "leader")
    leader.write(Batch([node("a", "t"), node("b", "t")], [edge("e", "a", "b", "r")]))
    follower = Follower(leader, Store(spark, f"{tmp_path}/f"))
    follower.stream(f"{tmp_path}/cp").awaitTermination()
    leader.write(Batch(node_deletes=["a"]))
    assert follower.lag == 1
    follower.stream(f"{tmp_path}/cp").awaitTermination()
    assert follower.lag == 0 and ids(follower.store.view().nodes) == ["b"] and ids(follower.store.view().edges) == []
    assert follower.pull() == 0
    with pytest.raises(ConflictError):
        follower.apply(leader.commit_record(2) | {"version": 3, "term": 0})


def test_json_lines(spark, tmp_path):
    nodes = [node("a", "t", {"s": 'q"\n', "i": 2**60, "f": 1.0, "b": False, "l": ["x"], "v": [0.5]}, {"default": [1.0, 2.5]}), node("b", "t")]
    view = GraphView(nodes_frame(spark, nodes), edges_frame(spark, [edge("e", "a", "b", "r", {"w": 3})]))
    jsonl.export(view, f"{tmp_path}/out")
    back_nodes, back_edges = jsonl.read(spark, f"{tmp_path}/out")
    key = lambda r: r["id"]
    assert sorted((r.asDict(True) for r in back_nodes.collect()), key=key) == sorted((r.asDict(True) for r in view.nodes.collect()), key=key)
    assert [r.asDict(True) for r in back_edges.collect()] == [r.asDict(True) for r in view.edges.collect()]
    (tmp_path / "bad").write_text('\n{"type":"node","id":"x"}\n')
    with pytest.raises(SerializationError):
        jsonl.read(spark, f"{tmp_path}/bad")


def test_streamed_response(chain):
    lines = list(R.stream(R.execute(chain, R.SearchByLabel("memory"))))
    assert len(lines) == 5 and '"meta"' in lines[0] and '"items": 3' in lines[-1]
    with pytest.raises(ValidationError):
        list(R.stream(R.execute(chain, R.SearchByLabel("memory")), most_items=2))
    with pytest.raises(ValidationError):
        R.execute(chain, R.SearchByLabel("memory")).checked(2)


def test_service(spark, chain):
    keys = Keys({"k": Principal("me", "writer")})
    assert keys.principal("k").may("write") and not keys.principal("k").may("admin")
    with pytest.raises(AccessError):
        keys.principal("x")
    now = [0.0]
    bucket = TokenBucket(2, 1.0, lambda: now[0])
    assert [bucket.take() for _ in range(3)] == [True, True, False]
    now[0] = 1.0
    assert bucket.take()
    log = AuditLog(spark, retain=2)
    for ms in (5, 60, 2000):
        log.append("me", "query", ms=ms)
    assert len(log.export(10)) == 2 and {r["band"] for r in latency_histogram(log.frame()).collect()} == {"le_250", "gt_1000"}
    assert 'band="gt_1000"} 1' in prometheus(latency_histogram(log.frame()))
    assert within_budget(chain) == {"nodes": 3, "edges": 2}
    with pytest.raises(ValidationError):
        within_budget(chain, config.MaintenanceBudget(1, 1))
    cluster = Cluster()
    cluster.join("a", "leader")
    cluster.join("b")
    cluster.acknowledge("a", 5)
    assert [m["lag"] for m in cluster.topology()] == [0, 5]
    assert cluster.promote("b") == 2 and cluster.leader().name == "b" and [m["lag"] for m in cluster.topology()] == [0, 0]
    cluster.report("a", False)
    with pytest.raises(ConflictError):
        cluster.promote("a")
    with pytest.raises(ValidationError):
        config.VectorConfig(backend="other")


def test_audit_log_is_durable(spark, tmp_path):
    log = AuditLog(spark, f"{tmp_path}/audit", retain=4, segment=2)
    for i in range(11):
        log.append("me", "query", str(i), ms=i)
    log.flush()
    again = AuditLog(spark, f"{tmp_path}/audit", retain=4)
    assert [json.loads(x)["target"] for x in again.export(3)] == ["8", "9", "10"] and again.export(0) == []
    assert 4 <= again.frame().count() <= 6


def test_calls_of_the_service(spark, tmp_path):
    keys = Keys({"r": Principal("reader", "reader"), "w": Principal("writer", "writer"), "a": Principal("admin", "admin")})
    service = Service(Store(spark, f"{tmp_path}/s"), keys, config.MaintenanceBudget(3, 3))
    assert service.create_node("w", node("a", "t", {"v": 1})) == 1 and service.put_node("w", "b", node("b", "t")) == 2
    assert service.create_edge("w", edge("e", "a", "b", "r")) == 3
    with pytest.raises(ValidationError):
        service.put_node("w", "c", node("b", "t"))
    with pytest.raises(AccessError):
        service.delete_node("r", "a")
    with pytest.raises(NotFoundError):
        service.delete_edge("w", "none")
    assert service.get_node("r", "a")["properties"]["v"]["i"] == 1 and service.get_edge("r", "e")["target"] == "b"
    tx = service.begin("w")
    assert service.stage("w", tx, "upsert_node", node("a", "t", {"v": 2}))["nodes"] == 1
    assert [t["id"] for t in service.transactions("r")] == [tx]
    seen = lambda transaction=None: dict(service.query("r", {"GetNodeById": {"node_id": "a"}}, transaction))["node"]["properties"]["v"]["i"]
    assert seen() == 1 and seen(tx) == 2
    assert json.loads(list(service.stream("r", {"SearchByLabel": {"label": "t"}}))[-1])["items"] == 2
    assert service.commit("w", tx) == 4 and service.transactions("r") == [] and seen() == 2
    with pytest.raises(NotFoundError):
        service.rollback("w", tx)
    with pytest.raises(AccessError):
        service.compact("w")
    assert service.compact("a") == 4 and service.integrity("a") == [] and service.maintenance("a")["within_budget"]
    assert service.prune("a") == [1, 2, 3, 4]
    for i in range(2):
        service.create_node("w", node(f"n{i}", "t"))
    with pytest.raises(ValidationError):
        service.backup("a", f"{tmp_path}/b")
    service.join("a", "one", "leader")
    service.acknowledge("a", "one", 6)
    service.join("a", "two")
    assert [m["lag"] for m in service.replication("a")["members"]] == [0, 6] and service.promote("a", "two") == 2
    assert json.loads(service.audit_export("a", 1)[0])["action"] == "promote" and "engram_latency_count" in service.metrics("a")
    slow = Service(service.store, keys, burst=1, rate=0.0, clock=lambda: 0.0)
    slow.get_node("r", "a")
    with pytest.raises(LimitError):
        slow.get_node("r", "a")
    slow.get_node("w", "a")


def test_of_racing_writers_one_wins(spark, tmp_path):
    files = Files(spark)
    for i in range(20):
        won, lost = [], []

        def write(n, i=i, won=won, lost=lost):
            try:
                files.write(f"{tmp_path}/race/{i}.json", str(n).encode())
                won.append(n)
            except ConflictError:
                lost.append(n)

        threads = [threading.Thread(target=write, args=(n,)) for n in range(6)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert len(won) == 1 and len(lost) == 5 and files.read(f"{tmp_path}/race/{i}.json") == str(won[0]).encode()
    assert all(n.endswith(".json") for n in files.names(f"{tmp_path}/race"))


def test_a_commit_between_check_and_publish_is_not_lost(spark, tmp_path, monkeypatch):
    store = Store(spark, f"{tmp_path}/s")
    store.write(Batch([node("a", "t", {"v": 1}), node("b", "t", {"v": 1})]))
    for name, rival, fails in (("a", "a", True), ("a", "b", False)):
        tx, other, real, raced = store.begin(), Store(spark, store.base), Store.write, []
        tx.upsert_node(node(name, "t", {"v": 10}))

        def write(self, batch, expected=None, real=real, raced=raced, other=other, rival=rival):
            if not raced:
                raced.append(1)
                real(other, Batch([node(rival, "t", {"v": 7})]))
            return real(self, batch, expected)

        monkeypatch.setattr(Store, "write", write)
        if fails:
            with pytest.raises(ConflictError):
                tx.commit()
        else:
            tx.commit()
        monkeypatch.undo()
        values = {r["id"]: r["properties"]["v"]["i"] for r in store.view().nodes.collect()}
        assert values[rival] == 7 and (fails or values[name] == 10)


def test_changed_data_is_found(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.write(Batch([node("a", "t", {"v": 1})]))
    store.compact()
    assert store.verify() == []
    for path, what in ((f"{store.base}/{store.commit_record(1)['path']}/nodes", "commit 1"), (f"{store.base}/snapshots/1/nodes", "snapshot 1")):
        rows = spark.createDataFrame(spark.read.parquet(path).withColumn("node_type", F.lit("u")).collect(), spark.read.parquet(path).schema)
        rows.write.mode("overwrite").parquet(path)
        assert [p for p in store.verify() if p.startswith(what)] == [f"{what}: nodes was changed"]


def test_prune_keeps_what_it_says(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    for i in range(3):
        store.write(Batch([node(f"n{i}", "t")]))
    store.compact()
    old = store.begin()
    for i in range(3, 6):
        store.write(Batch([node(f"n{i}", "t"), node("x", "t", {"v": i})], [edge(f"e{i}", f"n{i}", "n0", "r")]))
    assert store.prune(keep=2) == [1, 2, 3] and store.pruned() == 3
    assert store.verify() == [] and store.version == 6 and len(ids(store.view(4).nodes)) == 5 and len(ids(store.view().nodes)) == 7
    with pytest.raises(NotFoundError):
        store.view(2)
    assert sorted(r["far"] for r in traversal.steps(store.view(), INCOMING).where("near = 'n0'").collect()) == ["n3", "n4", "n5"]
    old.upsert_node(node("y", "t"))
    assert old.commit() == 7
    stale = store.begin()
    store.write(Batch([node("z", "t")]))
    store.prune()
    stale.upsert_node(node("q", "t"))
    with pytest.raises(ConflictError):
        stale.commit()
    back = Store.restore(spark, f"{tmp_path}/b", f"{tmp_path}/r") if store.backup(f"{tmp_path}/b") else None
    assert back.version == store.version and sorted(ids(back.view().nodes)) == sorted(ids(store.view().nodes)) and back.verify() == []


def test_index_is_opened_again(spark, tmp_path):
    rng = random.Random(3)
    store = Store(spark, f"{tmp_path}/s")
    store.write(Batch([node(f"n{i:03d}", "t", vectors={"default": [rng.gauss(0, 1) for _ in range(6)]}) for i in range(200)]))
    assert store.view().vector_index is None
    store.build_index(settings=config.VectorConfig(lists=8))
    view = Store(spark, store.base).view()
    assert view.vector_index.size == 200 and view.vector_index.dimension == 6
    memory = vectors.space(view)
    queries = memory.where("id like '%0'").select(F.col("id").alias("query_id"), "vector")
    exact = vectors.search_batch(memory, queries, 7)
    for probes, block in ((1, 4096), (3, 4)):
        near = view.vector_index.search_batch(queries, 7, probes, block)
        assert vectors.recall(exact, near, 7).first().asDict() == {"queries": 20, "recall": 1.0}
        assert sorted((r.query_id, r.id, r["rank"]) for r in near.collect()) == sorted((r.query_id, r.id, r["rank"]) for r in exact.collect())
    store.write(Batch([node("more", "t")]))
    assert store.view().vector_index is None and store.rebuild_indexes(config.VectorConfig(lists=8)) == ["default"] and store.view().vector_index.size == 200


def test_nearest_rank(spark):
    rng = random.Random(7)
    for values in ([3.0], [1.0, 1.0, 2.0], [rng.gauss(0, 1) for _ in range(500)] + [0.5] * 100 + [1e9, -1e9], [5.0] * 9):
        frame = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
        got = {r.percent: r.value for r in nearest_rank(frame, "v", [1, 33.3, 50, 95, 100]).collect()}
        own = sorted(values)
        assert got == {float(p): own[max(1, -(-len(own) * p // 100) if isinstance(p, int) else int(-(-len(own) * p // 100))) - 1] for p in (1, 33.3, 50, 95, 100)}
    assert nearest_rank(spark.createDataFrame([], "v double"), "v", [50]).collect() == []
    with pytest.raises(ValidationError):
        nearest_rank(spark.createDataFrame([], "v double"), "v", [0])


def test_store_of_the_first_format(spark, tmp_path):
    nodes = json.dumps({"format_version": 1, "records": [{"id": "node_a", "node_type": "memory", "properties": {"timestamp": {"kind": "Integer", "value": 1000}}}]}, indent=2)
    edges = json.dumps({"format_version": 1, "records": []}, indent=2)
    files = {}
    for folder, text in (("nodes", nodes), ("edges", edges)):
        (tmp_path / folder).mkdir()
        path = f"{folder}/segment-0000000000000001.snapshot.json"
        (tmp_path / path).write_text(text)
        files[path] = {"relative_path": path, "checksum_crc32": zlib.crc32(text.encode())}
    (tmp_path / "manifest.json").write_text(json.dumps({"storage_version": "1", "files": files}))
    view = legacy.read(spark, str(tmp_path))
    assert [(r["id"], r["timestamp_ms"]) for r in view.nodes.collect()] == [("node_a", 1000)] and view.edges.count() == 0
    (tmp_path / "nodes/segment-0000000000000001.snapshot.json").write_text(nodes.replace("1000", "1001"))
    with pytest.raises(CorruptionError):
        legacy.read(spark, str(tmp_path))
    with pytest.raises(NotFoundError):
        legacy.read(spark, f"{tmp_path}/none")


def test_command_line(spark, tmp_path, capsys):
    base = f"{tmp_path}/s"

    def run(*arguments):
        code = main([base, *arguments], spark)
        out, err = capsys.readouterr()
        return (code, err) if code else [json.loads(x) for x in out.splitlines()]

    assert run("put-node", json.dumps({"id": "a", "node_type": "t", "properties": {"v": 1}, "vectors": {"default": [1, 0]}})) == [{"version": 1}]
    batch = {"nodes": [{"id": "b", "node_type": "t", "vectors": {"default": [0, 1]}}], "edges": [{"id": "e", "source": "a", "target": "b", "edge_type": "r"}]}
    assert run("write", json.dumps(batch)) == [{"version": 2}]
    assert run("get-node", "a")[0]["properties"]["v"]["i"] == 1 and run("get-edge", "e")[0]["source"] == "a"
    assert run("get-node", "none")[0] == 1 and run("labels") == [{"t": 2}]
    (answer,) = run("query", json.dumps({"ListNeighbors": {"node_id": "a", "direction": "Outgoing"}}))
    assert [x["id"] for x in answer["items"]] == ["b", "e"] and not answer["truncated"]
    assert run("query-lines", json.dumps({"SearchByLabel": {"label": "t"}}))[-1]["items"] == 2
    assert run("query", json.dumps({"Nothing": {}}))[1].startswith("ValidationError")
    assert run("index")[0]["vectors"] == 2 and run("index-quality", "--every", "1", "--k", "2") == [{"queries": 2, "recall": 1.0}]
    assert run("compact") == [{"version": 2}] and run("verify") == [{"problems": []}]
    assert run("export-lines", f"{tmp_path}/lines")[0]["version"] == 2
    assert main([f"{tmp_path}/t", "import-lines", f"{tmp_path}/lines"], spark) == 0
    assert run("drill", "--folder", f"{tmp_path}/drill")[-1]["passed"]
    assert run("backup", f"{tmp_path}/backup")[-1]["version"] == 2
    assert main([f"{tmp_path}/u", "restore", f"{tmp_path}/backup"], spark) == 0 and Store(spark, f"{tmp_path}/u").version == 2
    capsys.readouterr()
    assert run("consolidate", "--now", "1")[0]["events"] == {} and run("delete-edge", "e") == [{"version": 3}] and run("delete-node", "b") == [{"version": 4}]
    assert run("prune") == [{"dropped": [1, 2, 3, 4]}] and run("status")[0]["pruned"] == 4
    assert run("topology") == [{"term": 1, "members": []}] and run("audit") == []
