"""The driver's tables as a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NODE_RECORD, GraphView, no_properties, promote
from ..model import properties as props


def _id(kind: str, *keys: str) -> Column:
    return F.concat_ws("_", F.lit(kind), *(F.col(k).cast("string") for k in keys))


def _ms(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def nodes_of(spark: SparkSession, sf_dir: str, part_keys: bool = False) -> DataFrame:
    """customer, orders, part, supplier, nation, region, event and memory nodes. With part_keys, a part's name is its
    unique key, which repeats."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    none = F.create_map().cast(NODE_RECORD["vectors"].dataType)
    c = F.col

    def made(df: DataFrame, kind: str, key: str, p: Column, vectors: Column = none) -> DataFrame:
        return df.select(_id(kind, key).alias("id"), F.lit(kind).alias("node_type"), p.alias("properties"), vectors.alias("vectors"))

    events = read("events").select("event_id", _ms("ts").alias("ms"), "user_id", "event_type", "value")
    memory = read("embeddings").join(events.select(c("event_id").alias("vec_id"), "ms", "value"), "vec_id", "left")
    key = {"unique_key": ("String", c("p_name"))} if part_keys else {"name": ("String", c("p_name"))}
    parts = [
        made(read("customer"), "customer", "c_custkey", props(unique_key=("String", c("c_name")), acctbal=("Float", c("c_acctbal")), mktsegment=("String", c("c_mktsegment")))),
        made(read("orders"), "orders", "o_orderkey", props(timestamp=("Integer", _ms("o_orderdate")), totalprice=("Float", c("o_totalprice")), status=("String", c("o_orderstatus")), priority=("String", c("o_orderpriority")))),
        made(read("part"), "part", "p_partkey", props(size=("Integer", c("p_size")), retailprice=("Float", c("p_retailprice")), **key)),
        made(read("supplier"), "supplier", "s_suppkey", props(acctbal=("Float", c("s_acctbal")), name=("String", c("s_name")))),
        made(read("nation"), "nation", "n_nationkey", props(name=("String", c("n_name")))),
        made(read("region"), "region", "r_regionkey", props(name=("String", c("r_name")))),
        made(events, "event", "event_id", props(timestamp=("Integer", c("ms")), value=("Float", c("value")), event_type=("String", c("event_type")), user_id=("Integer", c("user_id")))),
        made(memory, "memory", "vec_id", props(timestamp=("Integer", c("ms")), importance=("Float", c("value") / 500), confidence=("Float", F.when(c("vec_id") % 2 == 0, (c("vec_id") % 10) / 10)), label=("Integer", c("label"))), F.create_map(F.lit("default"), c("embedding"))),
    ]
    return promote(reduce(DataFrame.unionByName, parts))


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")

    def made(df: DataFrame, kind: str, identifier: Column, source: Column, target: Column) -> DataFrame:
        return df.select(identifier.alias("id"), source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"), no_properties().alias("properties"))

    pairs = read("lineitem").select("l_orderkey", "l_partkey").distinct()
    chain = read("embeddings").select("vec_id")
    chain = chain.join(chain.select((F.col("vec_id") - 1).alias("vec_id")), "vec_id", "left_semi")
    parts = [
        made(read("orders"), "placed_by", _id("placed_by", "o_orderkey"), _id("orders", "o_orderkey"), _id("customer", "o_custkey")),
        made(read("customer"), "in_nation", _id("in_nation_c", "c_custkey"), _id("customer", "c_custkey"), _id("nation", "c_nationkey")),
        made(read("supplier"), "in_nation", _id("in_nation_s", "s_suppkey"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey")),
        made(read("nation"), "in_region", _id("in_region", "n_nationkey"), _id("nation", "n_nationkey"), _id("region", "n_regionkey")),
        made(pairs, "contains", _id("contains", "l_orderkey", "l_partkey"), _id("orders", "l_orderkey"), _id("part", "l_partkey")),
        made(chain, "relates_to", _id("relates_to", "vec_id"), _id("memory", "vec_id"), F.concat(F.lit("memory_"), (F.col("vec_id") + 1).cast("string"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def graph(spark: SparkSession, sf_dir: str, part_keys: bool = False) -> GraphView:
    return GraphView(nodes_of(spark, sf_dir, part_keys), edges_of(spark, sf_dir))
