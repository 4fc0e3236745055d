"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of the undirected edges (a, b) the smallest node that it reaches.

    Each round is two joins of edges with per-node minima; the minima are aggregated before they are shuffled, and a hub's
    edges are a skewed side of a sort-merge join, which adaptive execution splits. Rounds end when the edges are stars: every
    node has one edge to a smaller one, or only edges from larger ones. Edges with a null end or two equal ends are ignored;
    repeated edges count once; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    e = edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    e = written(e, "edges")

    def stars(e: DataFrame) -> bool:
        ends = e.select("a", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(b.alias("a"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        n = ends.groupBy("a").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        return not n.filter("down > 1 or down = 1 and up = 1").limit(1).count()

    while not stars(e):
        both = e.unionByName(e.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        e = written(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return e.select(a.alias("node"), b.alias("component")).unionByName(e.select(b.alias("node"), b.alias("component")).distinct())
