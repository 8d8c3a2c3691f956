"""Connected components by alternating large and small stars; only a change flag reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """edges (a, b), ids in any order -> (node, label): label is the smallest id that the node reaches; nodes without
    an edge are absent. Each round halves path lengths at least; a node's neighbours are never gathered, only min()
    is taken over them before the shuffle, so that a hub with many links costs no task more than its share.
    Nulls and loops are dropped; repeated links count once; no links give no rows."""
    now = scratch.cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}-0"
    )
    mark, step = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.cut(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), f"{tag}-{step}-low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.cut(large, f"{tag}-{step}-large")
        low = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}-{step}-min")
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        step += 1
        following = scratch.cut(small.filter("u <> v").distinct(), f"{tag}-{step}")
        seen = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{tag}-{step - 1}-large")
        if seen == mark:
            return following.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(following.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        mark, now = seen, following
