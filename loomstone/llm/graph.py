"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, heavy_keys, spread_join


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``edges`` (columns ``a``, ``b``).

    Every round is a few aggregations and joins over the edges; neighbours of a node are never
    collected, and the rows of a node with very many are dealt to many tasks.  The number of rounds grows with the logarithm of the longest path.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        sign = now
        both = e.union(e.select("v", "u"))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        heavy = heavy_keys(least, ["u"], "n", 2 * now[0])  # the centre of a large star is a neighbour of most nodes
        large = spread_join(both.where("v > u"), least.select("u", F.least("u", "m").alias("m")), ["u"], heavy)
        large = cut(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # every neighbour here is smaller than its node
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
