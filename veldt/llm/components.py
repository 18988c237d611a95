"""Connected components of a graph given as edges, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component.

    edges has two long columns, a and b; self-loops and repeated edges are
    allowed. Alternates the two star operations until the edges stay as they
    are, which takes a number of rounds that grows with the logarithm of the
    nodes. Each round is written, so lost executors cost one round at most; a
    hub's edges are spread by the join, and minima are made before the
    shuffle.
    """
    nodes = edges.select("a").union(edges.select("b")).distinct()
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.withColumnRenamed("a", "node").join(roots.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
