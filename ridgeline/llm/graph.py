"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of edges (a, b: longs).

    Each step links every node to the smallest neighbour it knows, by an
    aggregation and a join on nodes; edges never outnumber the input's. It ends
    when all edges point from a node to its component's smallest, which takes
    about log(nodes) rounds.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Aggregates are written before they are joined: then a hot node's edges can be split over tasks.
        least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.filter("a != b").distinct())
        low = saved(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))))
        now = saved(small.filter("a != b").distinct())
        before, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == mark:
            break
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
