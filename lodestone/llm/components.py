"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import table


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges between long ids -> (node, component), the component being its smallest node.

    Only nodes with an edge to another node are returned; null ends and loops are ignored.  Each step joins
    the edges with one row per node, so no neighbourhood is ever gathered in one place and a hub of any degree
    is an ordinary skewed join.  Every step's edges are a stored table; steps are logarithmic in the number of nodes.
    They end when the edges are stars, without a step that changes nothing.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = table(e.where("a is not null and b is not null and a <> b").distinct())
    while True:
        # Large star: every larger neighbour of a node moves to the least of the node and its neighbours.
        least = e.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        e = e.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        # Small star: every smaller neighbour and the node itself move to the least of them.
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        e = table(moved.where("a <> b").distinct())
        # In stars, a node with an edge to a smaller one has no other edge.
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("below")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("below")))
        if ends.groupBy("node").agg(F.sum("below").alias("below"), F.count("*").alias("all")).where("below > 0 and all > 1").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def labels(edges: DataFrame, hops: int = 4) -> DataFrame:
    """(a, b) edges -> (node, component), the component being the smallest node at most `hops` edges away: one shuffle for each hop.

    Nodes with the same component are connected, but connected ones may differ; where that is enough, it is much cheaper.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().repartition("b")
    found = both.groupBy(F.col("b").alias("node")).agg(F.least(F.min("a"), F.first("b")).alias("component"))
    for _ in range(hops - 1):
        step = both.join(found.withColumnRenamed("node", "b"), "b")
        found = step.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("component"))
    return found
