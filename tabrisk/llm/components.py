"""Connected components of a graph given by its links, by alternating star contraction.

A round moves every node's larger neighbours to its smallest one (large star), then its smaller neighbours (small
star); links never become more, and a logarithmic number of rounds ends in stars around the smallest nodes. A
node's smallest neighbour is aggregated before the shuffle and joined back, so a node with very many links is not
gathered anywhere. Every round is cut with a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.llm.common import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # after the large star a > b in every link; the node itself joins its smallest neighbour too
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """`links` has two columns of nodes, a and b. Returns (node, component) for every node that has a link to
    another one; component is the smallest node that can be reached. Null nodes are ignored."""
    now = materialize(links.select("a", "b").filter("a <> b").distinct(), "links")
    state = None
    while True:
        large = _large_star(now)
        now = materialize(_small_star(large), "links")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
