"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import scratch, written


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of each node that has an edge. edges: a, b (long).

    Minima are aggregated before they are shuffled and the joins may be split, so a hub isn't gathered in one task.
    The number of rounds grows with the logarithm of the longest path.
    """
    with scratch(edges.sparkSession) as own:
        now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
        mark = None
        while True:
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            large = written(large, "components-large")
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            now = written(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "components")
            told = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if told == mark:
                break
            mark = told
        own.keep(now)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
