"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import time

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 12g pyspark-shell")

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from engramspark import queries as Q  # noqa: E402
from engramspark.lineage import cut  # noqa: E402
from engramspark.operators import lookup, paths, ranking, traversal, vectors  # noqa: E402
from engramspark.operators.traversal import BOTH, OUTGOING  # noqa: E402
from engramspark.sources.store import Store  # noqa: E402
from engramspark.sources.tables import graph  # noqa: E402


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    built = graph(spark, sf_dir)
    store = Store(spark, Q._folder(spark))
    times: dict[str, float] = {}

    def timed(name, f):
        began = time.perf_counter()
        out = f()
        times[name] = round(time.perf_counter() - began, 3)
        return out

    # the store's own write, with its checks, and the layout that readers use
    nodes, edges = timed("graph_build", lambda: (cut(built.nodes), cut(built.edges)))
    timed("graph_write", lambda: store.write_frames(nodes, edges))
    timed("graph_compact", store.compact)
    view = store.view()
    query = Q._query_vector(spark, sf_dir)
    memory = vectors.space(view)
    done = lambda df: df.write.format("noop").mode("overwrite").save()
    some = [r["id"] for r in view.nodes.where("node_type = 'orders'").orderBy("id").limit(10_000).select("id").collect()]
    wanted = spark.createDataFrame([(i,) for i in some], "id string")
    pairs = wanted.limit(1000)
    runs = {
        "exact_lookup": lambda: lookup.by_id(view, "orders_7").collect(),
        "label_scan": lambda: lookup.by_label(view, "customer", 1000).collect(),
        "neighbors": lambda: [x.collect() for x in traversal.neighbors(view, "customer_10")],
        "time_range": lambda: lookup.in_time_range(view, "timestamp", Q.NOW - 10 * Q.DAY, Q.NOW, 1000).collect(),
        "traverse_5": lambda: [x.collect() for x in traversal.traverse(view, "orders_5", OUTGOING, 5, 1000, 30_000)[:2]],
        "shortest_path_24": lambda: paths.shortest_path(view, "memory_3", "memory_27", OUTGOING, 24, 1000, 30_000),
        "vector_search": lambda: vectors.search(view, query, 50).collect(),
        "vector_search_all_pairs_top10": lambda: done(vectors.search_batch(memory, memory.select(F.col("id").alias("query_id"), "vector"), 10)),
        "ranked_hybrid": lambda: ranking.ranked(view, 50, Q.NOW, query, "memory_20").collect(),
        "reachable_from_all_orders": lambda: done(traversal.reachable(view, view.nodes.where("node_type = 'orders'").select("id"), 3, OUTGOING)),
        # many at once, in one plan: what a point costs where there are many
        "batch_lookup_10000": lambda: done(view.nodes.join(wanted, "id", "left_semi")),
        "batch_neighbors_of_all": lambda: done(traversal.steps(view, BOTH).groupBy("near").agg(F.count("*"))),
        "batch_paths_1000": lambda: done(traversal.reachable(view, pairs, 3, OUTGOING).where("id like 'region%'")),
    }
    lookup.by_id(view, "orders_7").collect()
    for name, f in runs.items():
        timed(name, f)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
