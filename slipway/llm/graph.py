"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slipway.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` (a, b) -> one row per linked node: node, component (the smallest node it can reach).

    Every step replaces each node's links by links to its smallest neighbour, which keeps the components and ends in
    stars. Rows of a step are written to the shared folder; only two counts reach the driver. Links with a null end
    and links of a node to itself are ignored.
    """
    pairs = links.filter("a is not null and b is not null and a <> b")
    edges = scratch.table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = scratch.table(both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").distinct())
        low = scratch.table(large.groupBy("b").agg(F.min("a").alias("m")))
        small = large.join(low, "b").filter("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
        after = scratch.table(small.unionByName(low.select(F.col("m").alias("x"), F.col("b").alias("y"))).select(
            F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        now = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        scratch.drop(edges, least, large, low)
        edges = after
        if now == state:
            break
        state = now
    roots = edges.select(F.col("a").alias("node")).distinct()
    return scratch.table(edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))))
