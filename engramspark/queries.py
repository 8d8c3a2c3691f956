"""The reference-level operators as queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .errors import ConflictError
from .functions import scores, values
from .functions.stats import nearest_rank
from .lineage import cut, shared_folder
from .model import GraphView, edge, edges_frame, node, nodes_frame
from .operators import consolidation, paths, ranking, traversal, vectors
from .operators.traversal import BOTH, INCOMING, OUTGOING
from .plans import predicates as P
from .plans import requests as R
from .service import latency_histogram
from .sources import jsonl
from .sources.store import Batch, Store
from .sources.tables import graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOW, DAY = 1_706_700_000_000, 86_400_000
#: The testbed graph in SQL.
GRAPH = """
n AS (
  SELECT 'customer_' || c_custkey AS id, 'customer' AS node_type, c_name AS unique_key, NULL::BIGINT AS ts, NULL::DOUBLE AS importance, NULL::DOUBLE AS confidence, c_acctbal AS acctbal, NULL::DOUBLE AS value, NULL::BIGINT AS user_id, c_mktsegment AS segment FROM customer
  UNION ALL SELECT 'orders_' || o_orderkey, 'orders', NULL, epoch_us(o_orderdate) // 1000, NULL, NULL, NULL, NULL, NULL, NULL FROM orders
  UNION ALL SELECT 'part_' || p_partkey, 'part', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'supplier_' || s_suppkey, 'supplier', NULL, NULL, NULL, NULL, s_acctbal, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'nation_' || n_nationkey, 'nation', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'region_' || r_regionkey, 'region', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM region
  UNION ALL SELECT 'event_' || event_id, 'event', NULL, epoch_us(ts) // 1000, NULL, NULL, NULL, value, user_id, NULL FROM events
  UNION ALL SELECT 'memory_' || vec_id, 'memory', NULL, epoch_us(e.ts) // 1000, e.value / 500, CASE WHEN vec_id % 2 = 0 THEN (vec_id % 10) / 10.0 END, NULL, NULL, NULL, NULL FROM embeddings LEFT JOIN events e ON e.event_id = vec_id),
e AS (
  SELECT 'placed_by_' || o_orderkey AS id, 'orders_' || o_orderkey AS source, 'customer_' || o_custkey AS target, 'placed_by' AS edge_type FROM orders
  UNION ALL SELECT 'in_nation_c_' || c_custkey, 'customer_' || c_custkey, 'nation_' || c_nationkey, 'in_nation' FROM customer
  UNION ALL SELECT 'in_nation_s_' || s_suppkey, 'supplier_' || s_suppkey, 'nation_' || s_nationkey, 'in_nation' FROM supplier
  UNION ALL SELECT 'in_region_' || n_nationkey, 'nation_' || n_nationkey, 'region_' || n_regionkey, 'in_region' FROM nation
  UNION ALL SELECT DISTINCT 'contains_' || l_orderkey || '_' || l_partkey, 'orders_' || l_orderkey, 'part_' || l_partkey, 'contains' FROM lineitem
  UNION ALL SELECT 'relates_to_' || a.vec_id, 'memory_' || a.vec_id, 'memory_' || (a.vec_id + 1), 'relates_to' FROM embeddings a SEMI JOIN embeddings b ON b.vec_id = a.vec_id + 1),
both_ways AS (SELECT source AS near, target AS far, id, edge_type FROM e UNION ALL SELECT target, source, id, edge_type FROM e WHERE source <> target)"""
QUERY = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
COSINE = f"(list_cosine_similarity(embedding::DOUBLE[], {QUERY}) + 1) / 2"


def query(sql: str | None = None):
    """sql may use the tables n, e and both_ways."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {GRAPH}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return add


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 0").first()["embedding"]]


@query("SELECT id, node_type, ts AS timestamp_ms FROM n WHERE id = 'orders_7'")
def get_node_by_id(spark, sf_dir):
    return R.execute(graph(spark, sf_dir), R.GetNodeById("orders_7")).nodes.select("id", "node_type", "timestamp_ms")


@query("SELECT id, node_type, unique_key FROM n WHERE unique_key = (SELECT c_name FROM customer WHERE c_custkey = 42) ORDER BY id DESC LIMIT 1")
def get_node_by_unique_key(spark, sf_dir):
    name = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey = 42").first()["c_name"]
    return R.execute(graph(spark, sf_dir), R.GetNodeByUniqueKey(name)).nodes.select("id", "node_type", "unique_key")


@query("SELECT id, node_type FROM n WHERE node_type = 'customer' ORDER BY id LIMIT 250")
def search_by_label(spark, sf_dir):
    return R.execute(graph(spark, sf_dir), R.SearchByLabel("customer", 250)).nodes.select("id", "node_type")


@query(f"SELECT id, ts AS timestamp_ms FROM n WHERE ts BETWEEN {NOW - 10 * DAY} AND {NOW} ORDER BY ts, id LIMIT 1000")
def time_range(spark, sf_dir):
    return R.execute(graph(spark, sf_dir), R.TimeRange("timestamp", NOW - 10 * DAY, NOW, 1000)).nodes.select("id", "timestamp_ms")


@query("SELECT id FROM n WHERE user_id BETWEEN 10 AND 20 ORDER BY id LIMIT 500")
def time_range_other_field(spark, sf_dir):
    return R.execute(graph(spark, sf_dir), R.TimeRange("user_id", 10, 20, 500)).nodes.select("id")


def _filtered(spark, sf_dir, where, label=None, limit=1000):
    return R.execute(graph(spark, sf_dir), R.FilterNodes(where, label, limit)).nodes.select("id", "node_type")


@query("SELECT id, node_type FROM n WHERE id = 'part_11'")
def filter_eq_id(spark, sf_dir):
    return _filtered(spark, sf_dir, P.eq("id", "part_11"))


@query("SELECT id, node_type FROM n WHERE node_type = 'nation' ORDER BY id LIMIT 1000")
def filter_eq_label(spark, sf_dir):
    return _filtered(spark, sf_dir, P.eq("label", "nation"))


@query("SELECT 'memory_' || vec_id AS id, 'memory' AS node_type FROM embeddings WHERE label = 3 ORDER BY 1 LIMIT 1000")
def filter_eq_integer_property_named_label(spark, sf_dir):
    return _filtered(spark, sf_dir, P.eq("label", 3.0))


@query("SELECT id, node_type FROM n WHERE segment = 'BUILDING' ORDER BY id LIMIT 1000")
def filter_eq_property(spark, sf_dir):
    return _filtered(spark, sf_dir, P.eq("mktsegment", "BUILDING"), "customer")


@query("SELECT id, node_type FROM n WHERE acctbal > 1000 AND acctbal <= 2500.5 ORDER BY id LIMIT 1000")
def filter_numeric_range(spark, sf_dir):
    return _filtered(spark, sf_dir, P.all_of(P.gt("acctbal", 1000), P.lte("acctbal", 2500.5)))


@query("SELECT id, node_type FROM n WHERE importance >= 0.05 AND (confidence < 0.3 OR confidence >= 0.8) ORDER BY id LIMIT 1000")
def filter_importance_and_confidence(spark, sf_dir):
    return _filtered(spark, sf_dir, P.all_of(P.gte("importance", 0.05), P.any_of(P.lt("confidence", 0.3), P.gte("confidence", 0.8))), "memory")


@query("SELECT id, node_type FROM n WHERE node_type = 'event' AND ((value < 20 AND user_id = 7) OR user_id >= 148) ORDER BY id LIMIT 1000")
def filter_and_or(spark, sf_dir):
    return _filtered(spark, sf_dir, P.any_of(P.all_of(P.lt("value", 20), P.eq("user_id", 7)), P.gte("user_id", 148)), "event")


@query("SELECT id, node_type FROM n WHERE false")
def filter_missing_property(spark, sf_dir):
    return _filtered(spark, sf_dir, P.any_of(P.gt("no_such_key", -1e300), P.eq("no_such_key", "")))


def _neighbor_sql(direction: str, node_id: str, limit: int, what: str) -> str:
    rows = {OUTGOING: f"SELECT 0 AS back, target AS far, * FROM e WHERE source = '{node_id}'", INCOMING: f"SELECT 1 AS back, source AS far, * FROM e WHERE target = '{node_id}'"}
    rows[BOTH] = f"{rows[OUTGOING]} UNION ALL {rows[INCOMING]} AND source <> target"
    last = "SELECT id, source, target, edge_type FROM p" if what == "edges" else "SELECT id, node_type FROM n WHERE id IN (SELECT far FROM p)"
    return f", p AS (SELECT * FROM ({rows[direction]}) ORDER BY back, id LIMIT {limit}) {last}"


def _neighbors(name: str, direction: str, node_id: str, limit: int) -> None:
    for what in ("nodes", "edges"):

        def run(spark, sf_dir, what=what):
            result = R.execute(graph(spark, sf_dir), R.ListNeighbors(node_id, direction, limit=limit))
            return result.nodes.select("id", "node_type") if what == "nodes" else result.edges.select("id", "source", "target", "edge_type")

        run.__name__ = f"list_neighbors_{name}_{what}"
        query(_neighbor_sql(direction, node_id, limit, what))(run)


_neighbors("out", OUTGOING, "orders_5", 100)
_neighbors("in", INCOMING, "nation_3", 50)
_neighbors("both", BOTH, "customer_10", 100)

WALK = ", w AS (SELECT '{start}' AS id, 0 AS depth UNION SELECT s.far, w.depth + 1 FROM w JOIN ({steps}) s ON s.near = w.id WHERE w.depth < {hops}), best AS (SELECT id, min(depth) AS depth FROM w GROUP BY 1)"
FORWARD = "SELECT source AS near, target AS far, id FROM e"


@query(WALK.format(start="orders_5", steps=FORWARD, hops=3) + " SELECT id, depth FROM best")
def traverse_nodes(spark, sf_dir):
    return R.execute(graph(spark, sf_dir), R.Traverse("orders_5", OUTGOING, max_hops=3, limit=1000)).nodes.select("id", "depth")


@query(WALK.format(start="orders_5", steps=FORWARD, hops=3) + " SELECT DISTINCT e.id, source, target FROM e JOIN best ON best.id = e.source WHERE depth <= 2")
def traverse_edges(spark, sf_dir):
    return R.execute(graph(spark, sf_dir), R.Traverse("orders_5", OUTGOING, max_hops=3, limit=1000)).edges.select("id", "source", "target")


@query(WALK.format(start="customer_10", steps="SELECT * FROM both_ways WHERE edge_type IN ('placed_by', 'contains') AND far IN (SELECT id FROM n WHERE node_type IN ('orders', 'part'))", hops=2) + " SELECT id, depth FROM best")
def traverse_constrained(spark, sf_dir):
    limits = {"edge_types": ["placed_by"], "node_labels": ["orders", "part"]}
    return R.execute(graph(spark, sf_dir), R.Traverse("customer_10", BOTH, "contains", 2, 1000, constraints=limits)).nodes.select("id", "depth")


@query(", w AS (SELECT id AS start, id, 0 AS depth FROM n WHERE node_type = 'supplier' UNION SELECT w.start, e.target, w.depth + 1 FROM w JOIN e ON e.source = w.id WHERE depth < 3) SELECT start, id, min(depth) AS depth FROM w GROUP BY 1, 2")
def reachable_from_all_suppliers(spark, sf_dir):
    view = graph(spark, sf_dir)
    return traversal.reachable(view, view.nodes.where("node_type = 'supplier'").select("id"), 3, OUTGOING)


@query(", w AS (SELECT id AS start, id, 0 AS depth FROM n WHERE node_type = 'orders' UNION SELECT w.start, e.target, w.depth + 1 FROM w JOIN e ON e.source = w.id WHERE depth < 3) SELECT node_type, m.depth, count(*) AS pairs FROM (SELECT start, id, min(depth) AS depth FROM w GROUP BY 1, 2) m JOIN n ON n.id = m.id GROUP BY 1, 2")
def reachable_from_all_orders(spark, sf_dir):
    view = graph(spark, sf_dir)
    found = traversal.reachable(view, view.nodes.where("node_type = 'orders'").select("id"), 3, OUTGOING)
    return found.join(view.nodes.select("id", "node_type"), "id").groupBy("node_type", "depth").agg(F.count("*").alias("pairs"))


@query(WALK.format(start="memory_20", steps="SELECT * FROM both_ways", hops=3) + " SELECT id, depth AS distance FROM best")
def graph_distances_3(spark, sf_dir):
    return traversal.distances(graph(spark, sf_dir), "memory_20", 3)


@query(WALK.format(start="customer_10", steps="SELECT * FROM both_ways WHERE edge_type = 'placed_by'", hops=3) + " SELECT id, depth AS distance, 1.0 / (1 + depth) AS structural FROM best")
def graph_distances_one_edge_type(spark, sf_dir):
    return traversal.distances(graph(spark, sf_dir), "customer_10", 3, "placed_by").withColumn("structural", scores.distance_score(F.col("distance")))


def _hops(spark, found) -> DataFrame:
    return spark.createDataFrame([(found.path.hop_count if found.path else -1,)], "hop_count long")


@query(WALK.format(start="memory_3", steps=FORWARD, hops=12) + " SELECT coalesce(min(depth), -1) AS hop_count FROM best WHERE id = 'memory_12'")
def shortest_path_hops(spark, sf_dir):
    return _hops(spark, paths.shortest_path(graph(spark, sf_dir), "memory_3", "memory_12", OUTGOING, 8, 1000, 30_000))


@query(", p AS (SELECT o.o_custkey, o.o_orderkey FROM orders o WHERE o_orderkey = 5) SELECT hop, id FROM (SELECT 0 AS hop, 'orders_' || o_orderkey AS id FROM p UNION ALL SELECT 1, 'customer_' || o_custkey FROM p UNION ALL SELECT 2, 'nation_' || c_nationkey FROM p JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 3, 'region_' || n_regionkey FROM p JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)")
def shortest_path_nodes(spark, sf_dir):
    view = graph(spark, sf_dir)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey = 5").first()["o_custkey"]
    nation = spark.read.parquet(f"{sf_dir}/customer.parquet").where(f"c_custkey = {o}").first()["c_nationkey"]
    region = spark.read.parquet(f"{sf_dir}/nation.parquet").where(f"n_nationkey = {nation}").first()["n_regionkey"]
    found = R.execute(view, R.ShortestPath("orders_5", f"region_{region}", OUTGOING, limit=1000, timeout_ms=30_000))
    return spark.createDataFrame(list(enumerate(found.path.node_ids)), "hop long, id string")


@query("SELECT -1 AS hop_count")
def shortest_path_none(spark, sf_dir):
    return _hops(spark, paths.shortest_path(graph(spark, sf_dir), "region_0", "memory_0", OUTGOING, 3))


@query(f"SELECT 'memory_' || vec_id AS id, round({COSINE}, 6) AS score FROM embeddings ORDER BY {COSINE} DESC, 1 LIMIT 20")
def vector_search(spark, sf_dir):
    return R.execute(graph(spark, sf_dir), R.VectorSearch(tuple(_query_vector(spark, sf_dir)), 20)).ranked.select("id", F.round("score", 6).alias("score"))


@query(f"SELECT 'memory_' || vec_id AS id, round({COSINE}, 6) AS score FROM embeddings ORDER BY {COSINE} DESC, 1 LIMIT 5")
def vector_search_label(spark, sf_dir):
    return R.execute(graph(spark, sf_dir), R.VectorSearch(tuple(_query_vector(spark, sf_dir)), 5, "memory", "default", 50)).ranked.select("id", F.round("score", 6).alias("score"))


@query("SELECT id, 0.0::DOUBLE AS score FROM n WHERE false")
def vector_search_unknown_label(spark, sf_dir):
    return R.execute(graph(spark, sf_dir), R.VectorSearch(tuple(_query_vector(spark, sf_dir)), 5, "no_such_label")).ranked.select("id", "score")


@query("SELECT 'memory_' || vec_id AS id, 0.0::DOUBLE AS score FROM embeddings ORDER BY 1 LIMIT 10")
def vector_search_dim_mismatch(spark, sf_dir):
    return R.execute(graph(spark, sf_dir), R.VectorSearch((1.0, 2.0, 3.0), 10)).ranked.select("id", "score")


@query("SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT 'memory_' || q.vec_id AS query_id, 'memory_' || v.vec_id AS id, (list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) + 1) / 2 AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= 5")
def vector_search_batch(spark, sf_dir):
    memory = vectors.space(graph(spark, sf_dir))
    queries = memory.where(F.substring_index("id", "_", -1).cast("int") % 20 == 0).select(F.col("id").alias("query_id"), "vector")
    return vectors.search_batch(memory, queries, 5).withColumn("score", F.round("score", 6))


PARTS = "CASE WHEN ts IS NULL THEN 0 WHEN ts >= {now} THEN 1 ELSE 1 / (1 + ({now} - ts) / 604800000.0) END AS temporal, least(greatest(coalesce(importance, 0.5), 0), 1) AS imp, least(greatest(coalesce(confidence, 0.5), 0), 1) AS conf"
RANKED = WALK.format(start="{ref}", steps="SELECT * FROM both_ways{types}", hops=3) + """, s AS (SELECT 'memory_' || vec_id AS id, {cosine} AS semantic FROM embeddings),
parts AS (SELECT n.id, coalesce(1.0 / (1 + best.depth), 0) AS structural, coalesce(s.semantic, 0) AS semantic, """ + PARTS + """ FROM n LEFT JOIN best ON best.id = n.id LEFT JOIN s ON s.id = n.id WHERE {where}),
total AS (SELECT *, 0.30 * structural + 0.30 * semantic + 0.15 * temporal + 0.15 * imp + 0.10 * conf AS score FROM parts)
SELECT id, round(score, 6) AS score, round(structural, 6) AS structural_score, round(semantic, 6) AS semantic_score, round(temporal, 6) AS temporal_score FROM total ORDER BY round(score, 9) DESC, id LIMIT {limit}"""


def _ranked_sql(limit: int, where: str, ref: str = "", cosine: str = "0.0::DOUBLE", types: str = "") -> str:
    return RANKED.format(ref=ref, types=types, cosine=cosine, now=NOW, where=where, limit=limit)


def _ranked(spark, sf_dir, **request) -> DataFrame:
    rows = R.execute(graph(spark, sf_dir), R.RankedRetrieval(now_epoch_ms=NOW, **request)).ranked
    return rows.select("id", *(F.round(c, 6).alias(c) for c in ("score", "structural_score", "semantic_score", "temporal_score")))


@query(_ranked_sql(25, "n.id IN (SELECT id FROM s)", cosine=COSINE))
def ranked_vector_only(spark, sf_dir):
    return _ranked(spark, sf_dir, limit=25, query_vector=tuple(_query_vector(spark, sf_dir)))


@query(_ranked_sql(25, "true", ref="memory_20"))
def ranked_reference_only(spark, sf_dir):
    return _ranked(spark, sf_dir, limit=25, reference_node_id="memory_20")


@query(_ranked_sql(40, "n.id IN (SELECT id FROM s) OR best.depth IS NOT NULL", ref="memory_20", cosine=COSINE))
def ranked_hybrid(spark, sf_dir):
    return _ranked(spark, sf_dir, limit=40, query_vector=tuple(_query_vector(spark, sf_dir)), reference_node_id="memory_20", retrieval_profile="v1-default")


@query(_ranked_sql(30, f"(n.id IN (SELECT id FROM s) OR best.depth IS NOT NULL) AND ts BETWEEN {NOW - 31 * DAY} AND {NOW - 30 * DAY}", ref="memory_20", cosine=COSINE, types=" WHERE edge_type = 'relates_to'"))
def ranked_time_window(spark, sf_dir):
    return _ranked(spark, sf_dir, limit=30, query_vector=tuple(_query_vector(spark, sf_dir)), reference_node_id="memory_20", edge_type="relates_to", from_epoch_ms=NOW - 31 * DAY, to_epoch_ms=NOW - 30 * DAY)


@query(", total AS (SELECT 0.30 * (" + COSINE.replace("embedding::", "m.embedding::", 1).replace("(SELECT m.embedding", "(SELECT embedding") + f") + 0.15 * (CASE WHEN n.ts IS NULL THEN 0 WHEN n.ts >= {NOW} THEN 1 ELSE 1 / (1 + ({NOW} - n.ts) / 604800000.0) END) + 0.15 * least(greatest(coalesce(n.importance, 0.5), 0), 1) + 0.10 * least(greatest(coalesce(n.confidence, 0.5), 0), 1) AS score FROM embeddings m JOIN n ON n.id = 'memory_' || m.vec_id ORDER BY score DESC LIMIT 200) SELECT CASE WHEN score < 0.25 THEN 'low' WHEN score < 0.5 THEN 'medium' WHEN score < 0.75 THEN 'high' ELSE 'top' END AS band, count(*) AS count FROM total GROUP BY 1")
def ranked_score_histogram(spark, sf_dir):
    return ranking.score_histogram(ranking.ranked(graph(spark, sf_dir), 200, NOW, _query_vector(spark, sf_dir)))


@query("SELECT 'part_' || min(k) AS target, count(*) - 1 AS duplicates, string_agg(k, ',' ORDER BY k) AS members FROM (SELECT p_name, p_partkey::VARCHAR AS k FROM part) GROUP BY p_name HAVING count(*) > 1")
def consolidate_merge(spark, sf_dir):
    found = consolidation.merges(graph(spark, sf_dir, part_keys=True)).where("node_type = 'part'")
    members = F.array_join(F.transform(F.concat(F.array("target"), "related"), lambda x: F.regexp_replace(x, "part_", "")), ",")
    return found.select("target", F.size("related").cast("long").alias("duplicates"), members.alias("members"))


@query("SELECT id FROM n WHERE id NOT IN (SELECT source FROM e UNION SELECT target FROM e)")
def consolidate_demote(spark, sf_dir):
    return consolidation.isolated(graph(spark, sf_dir)).select("id")


@query(f"SELECT id FROM n WHERE {NOW} - ts > {30 * DAY}")
def consolidate_archive(spark, sf_dir):
    return consolidation.stale(graph(spark, sf_dir), NOW).select("id")


@query(f", part_nodes AS (SELECT p_name, min('part_' || p_partkey) AS target, count(*) AS c FROM part GROUP BY 1 HAVING count(*) > 1), events_ AS (SELECT 'Merge' AS action, count(*) AS n FROM part_nodes UNION ALL SELECT 'Demote', count(*) FROM n WHERE id NOT IN (SELECT source FROM e UNION SELECT target FROM e) UNION ALL SELECT 'Archive', count(*) FROM n WHERE {NOW} - ts > {30 * DAY}) SELECT * FROM events_ WHERE n > 0")
def consolidate_events(spark, sf_dir):
    return consolidation.analyse(graph(spark, sf_dir, part_keys=True), NOW).groupBy("action").agg(F.count("*").alias("n"))


@query(f"SELECT id, CASE WHEN {NOW} - ts > {30 * DAY} THEN true END AS archived, CASE WHEN node_type = 'event' THEN 0.25 ELSE importance END AS importance FROM n WHERE node_type IN ('event', 'memory', 'orders')")
def consolidate_apply(spark, sf_dir):
    view = graph(spark, sf_dir)
    after, _ = consolidation.apply(view, consolidation.analyse(view, NOW))
    return after.nodes.where("node_type in ('event', 'memory', 'orders')").select("id", F.col("properties")["archived"]["b"].alias("archived"), "importance")


def _staged(spark, sf_dir) -> GraphView:
    view = graph(spark, sf_dir)
    added = nodes_frame(spark, [node("memory_1", "profile", {"score": 9}), node("extra_1", "profile", {"score": 3})])
    links = edges_frame(spark, [edge("extra_edge", "extra_1", "memory_2", "relates_to")])
    gone = spark.createDataFrame([("nation_3",)], "id string")
    cut = spark.createDataFrame([("relates_to_2",)], "id string")
    return view.overlay(added, links, gone, cut)


@query("SELECT id, node_type FROM n WHERE id NOT IN ('memory_1', 'nation_3') AND node_type IN ('memory', 'nation') UNION ALL SELECT 'memory_1', 'profile' UNION ALL SELECT 'extra_1', 'profile'")
def txn_overlay_view(spark, sf_dir):
    return _staged(spark, sf_dir).nodes.where("node_type in ('memory', 'nation', 'profile')").select("id", "node_type")


@query("SELECT id, edge_type FROM e WHERE source <> 'nation_3' AND target <> 'nation_3' AND id <> 'relates_to_2' AND edge_type <> 'contains' UNION ALL SELECT 'extra_edge', 'relates_to'")
def cascade_delete(spark, sf_dir):
    return _staged(spark, sf_dir).edges.where("edge_type <> 'contains'").select("id", "edge_type")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, sf_dir: str) -> Store:
    """Four commits: all nodes and edges; an upsert and a delete; one id written and deleted; one node
    deleted with its edges. A snapshot after the second."""
    view, store = graph(spark, sf_dir), Store(spark, _folder(spark))
    store.write_frames(cut(view.nodes), cut(view.edges))
    store.write(Batch(nodes=[node("nation_0", "nation", {"name": "RENAMED"})], edge_deletes=["in_region_4"]))
    store.compact()
    store.write(Batch(nodes=[node("nation_77", "nation"), node("nation_5", "nation", {"name": "GONE"})], node_deletes=["nation_5"]))
    store.write(Batch(node_deletes=["region_2"]))
    return store


NAMES = "SELECT 'part_' || p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'supplier_' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'nation_' || n_nationkey, CASE WHEN n_nationkey = 0 THEN 'RENAMED' ELSE n_name END FROM nation UNION ALL SELECT 'region_' || r_regionkey, r_name FROM region"


@query(f"SELECT n.id, names.name FROM n LEFT JOIN ({NAMES}) AS names ON names.id = n.id WHERE n.id NOT IN ('nation_5', 'region_2') UNION ALL SELECT 'nation_77', NULL")
def batch_upsert_delete_same_id(spark, sf_dir):
    return _stored(spark, sf_dir).view().nodes.select("id", F.col("properties")["name"]["s"].alias("name"))


@query("SELECT id FROM e WHERE id <> 'in_region_4' AND source NOT IN ('nation_5', 'region_2') AND target NOT IN ('nation_5', 'region_2')")
def store_cascade(spark, sf_dir):
    return _stored(spark, sf_dir).view().edges.select("id")


@query("SELECT 1 AS version, 'nation_' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 2, 'nation_' || n_nationkey, CASE WHEN n_nationkey = 0 THEN 'RENAMED' ELSE n_name END FROM nation")
def store_as_of(spark, sf_dir):
    store = _stored(spark, sf_dir)
    return store.view(1).nodes.withColumn("version", F.lit(1)).unionByName(store.view(2).nodes.withColumn("version", F.lit(2))).where("node_type = 'nation'").select("version", "id", F.col("properties")["name"]["s"].alias("name"))


@query("SELECT id, node_type, ts AS timestamp_ms, round(importance, 9) AS importance, confidence FROM n")
def jsonl_round_trip(spark, sf_dir):
    view, path = graph(spark, sf_dir), f"{_folder(spark)}.jsonl"
    jsonl.export(view, path)
    nodes, _ = jsonl.read(spark, path)
    return nodes.select("id", "node_type", "timestamp_ms", F.round("importance", 9).alias("importance"), "confidence")


@query("SELECT node_type, count(*) AS nodes FROM n GROUP BY 1")
def count_by_label(spark, sf_dir):
    return R.count_by_label(graph(spark, sf_dir))


@query("SELECT edge_type, count(*) AS edges, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM e GROUP BY 1")
def count_by_edge_type(spark, sf_dir):
    return graph(spark, sf_dir).edges.groupBy("edge_type").agg(F.count("*").alias("edges"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"))


@query("SELECT event_type AS action, CASE WHEN value <= 10 THEN 'le_10' WHEN value <= 50 THEN 'le_50' WHEN value <= 250 THEN 'le_250' WHEN value <= 1000 THEN 'le_1000' ELSE 'gt_1000' END AS band, count(*) AS n, round(sum(value), 4) AS total_ms FROM events GROUP BY 1, 2")
def latency_histogram_of_events(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("action"), F.col("value").alias("ms"))
    return latency_histogram(rows).withColumn("total_ms", F.round("total_ms", 4))


@query(f"SELECT event_id, CASE WHEN ts_ms >= {NOW - 5 * DAY} THEN 1.0 ELSE round(1 / (1 + ({NOW - 5 * DAY} - ts_ms) / 604800000.0), 9) END AS recency FROM (SELECT event_id, epoch_us(ts) // 1000 AS ts_ms FROM events)")
def recency_of_events(spark, sf_dir):
    nodes = graph(spark, sf_dir).nodes.where("node_type = 'event'")
    return nodes.select(F.substring_index("id", "_", -1).cast("long").alias("event_id"), F.round(scores.recency(F.col("timestamp_ms"), NOW - 5 * DAY), 9).alias("recency"))


@query("SELECT 'memory_' || vec_id AS id, label::DOUBLE AS label_number, trunc(label)::BIGINT AS label_long FROM embeddings")
def property_coercion(spark, sf_dir):
    p = F.col("properties")["label"]
    return graph(spark, sf_dir).nodes.where("node_type = 'memory'").select("id", values.as_double(p).alias("label_number"), values.as_long(p).alias("label_long"))


@query("SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) AS queries, true AS recall_at_10, true AS recall_at_50")
def ann_quality(spark, sf_dir):
    """The index at its defaults, saved and opened again, against exact search, for all vectors whose id is divisible by 20: whether recall
    is 0.9 or more."""
    view, path = graph(spark, sf_dir), f"{_folder(spark)}.ivf"
    vectors.build_index(view, path)
    memory, index = vectors.space(view), vectors.InvertedFile.open(spark, path)
    queries = memory.where(F.substring_index("id", "_", -1).cast("int") % 20 == 0).select(F.col("id").alias("query_id"), "vector")
    exact, near = vectors.search_batch(memory, queries, 50), index.search_batch(queries, 50)
    at = {k: vectors.recall(exact, near, k).select("queries", (F.col("recall") >= 0.9).alias(f"recall_at_{k}")) for k in (10, 50)}
    return at[10].join(at[50], "queries")


@query(f"SELECT 'memory_' || vec_id AS id, round({COSINE}, 6) AS score FROM embeddings ORDER BY {COSINE} DESC, 1 LIMIT 50")
def vector_search_indexed(spark, sf_dir):
    """One query through the index, whatever the size of the space."""
    view, settings = graph(spark, sf_dir), config.VectorConfig(exact_threshold=0)
    index = vectors.build_index(view, f"{_folder(spark)}.ivf", settings=settings)
    indexed = GraphView(view.nodes, view.edges, vector_index=index)
    return vectors.search(indexed, _query_vector(spark, sf_dir), 50, settings=settings).select("id", F.round("score", 6).alias("score"))


@query("SELECT CAST(p AS DOUBLE) AS percent, (SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) AS r FROM events WHERE value IS NOT NULL) WHERE r = greatest(1, ceil(p / 100.0 * (SELECT count(value) FROM events)))) AS value FROM (VALUES (1), (50), (95), (99), (100)) AS t(p)")
def nearest_rank_percentiles(spark, sf_dir):
    return nearest_rank(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", [1, 50, 95, 99, 100])


@query("SELECT id, node_type, ts AS timestamp_ms FROM n WHERE ts > 1704100000000.5 AND ts <= 1704900000000 ORDER BY id LIMIT 1000")
def filter_timestamp(spark, sf_dir):
    where = P.all_of(P.gt("timestamp", 1_704_100_000_000.5), P.lte("timestamp", 1_704_900_000_000))
    return R.execute(graph(spark, sf_dir), R.FilterNodes(where, None, 1000)).nodes.select("id", "node_type", "timestamp_ms")


@query("SELECT 'nation_' || n_nationkey AS id, CASE WHEN n_nationkey = 1 THEN 'A' WHEN n_nationkey = 2 THEN 'C' ELSE n_name END AS name FROM nation")
def transactions_interleaved(spark, sf_dir):
    """Of two transactions that write one node the later one fails; one that writes another node commits on top, though it began before."""
    view, store = graph(spark, sf_dir), Store(spark, _folder(spark))
    store.write_frames(view.nodes.where("node_type = 'nation'"))
    first, second, third = store.begin(), store.begin(), store.begin()
    first.upsert_node(node("nation_1", "nation", {"name": "A"}))
    second.upsert_node(node("nation_1", "nation", {"name": "B"}))
    third.upsert_node(node("nation_2", "nation", {"name": "C"}))
    first.commit()
    try:
        second.commit()
    except ConflictError:
        second.rollback()
    third.commit()
    return store.view().nodes.select("id", F.col("properties")["name"]["s"].alias("name"))


@query(", w AS (SELECT DISTINCT target AS near, source AS far FROM e WHERE edge_type = 'placed_by') SELECT near AS id, count(*) AS orders FROM w GROUP BY 1")
def incoming_of_all_customers(spark, sf_dir):
    """Steps against the edges, from the copy of a compacted store that is laid out by target."""
    view, store = graph(spark, sf_dir), Store(spark, _folder(spark))
    store.write_frames(view.nodes.where("node_type in ('customer', 'orders')"), view.edges.where("edge_type = 'placed_by'"))
    store.prune()
    return traversal.steps(store.view(), INCOMING).groupBy(F.col("near").alias("id")).agg(F.count("*").alias("orders"))


@query("SELECT id, node_type FROM n")
def replication_catch_up(spark, sf_dir):
    from .streaming.replication import Follower

    view, leader = graph(spark, sf_dir), Store(spark, _folder(spark), "leader")
    leader.write_frames(cut(view.nodes), cut(view.edges))
    leader.write(Batch(nodes=[node("extra", "thing")]))
    leader.write(Batch(node_deletes=["extra"]))
    follower = Follower(leader, Store(spark, _folder(spark), "follower"))
    running = follower.stream(f"{_folder(spark)}.checkpoint")
    running.awaitTermination()
    return follower.store.view().nodes.select("id", "node_type")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_hybrid(spark, sf_dir)
