"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm._common import cut, drop_cut, looked_up

#: Nodes of most edges, whose smallest neighbours are sent to all tasks, so that their edges need no shuffle.
HEAVY = 1000


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, component) for the end points of edges (a, b); the component is its smallest node.

    Each step is an aggregation and a join on a node.  A node's smallest neighbour is aggregated before the
    shuffle; in the join, the edges of the HEAVY nodes of most edges stay where they are, so the largest group
    that a task gathers is that of a lighter node: under a thousandth of the edges.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(most):
        if is_flat(now):
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m")).select("u", "n", F.least("u", "m").alias("m"))
        large = cut(looked_up(both, ["u"], low, HEAVY).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        low = large.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m"))
        small = looked_up(large, ["u"], low, HEAVY).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = cut(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        drop_cut(now)
        drop_cut(large)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def is_flat(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node that has none: then those are the components' smallest nodes."""
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    deeper = edges.select("u").distinct().join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return twice.union(deeper).limit(1).count() == 0
