"""Connected components by star contractions, cut to the shared checkpoint folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoint import cut


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) of integers -> (node, component): each linked node with the least node it reaches.

    A round hangs every node's larger neighbours onto its least one (large star), then its smaller
    neighbours and itself (small star). The number of links never grows and the rounds grow with the
    logarithm of the nodes. Grouping is a minimum with map-side combine, so a node with very many
    links is no single task's group. Self links, repeated links and nulls are ignored; no links give
    an empty result. Done once every link leads straight to a node that is nobody's larger end.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = cut(small.select("b", "m").union(small.select("a", "m")).toDF("a", "b").filter("a <> b").distinct())
        # Settled if no node has two links down, and none that links down is linked to.
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR (down > 0 AND up > 0)").isEmpty():
            break
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
