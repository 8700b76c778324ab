"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, land


def components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node, root)``: root is the smallest node reachable.

    Each step hangs neighbours under the smallest one known; the number of steps grows with the
    logarithm of the longest path. Minima are partial aggregates, and the joins back are plain
    shuffle joins of landed tables, so a node with very many neighbours is split by AQE. Every
    step is landed in the shared folder. No links give no rows.
    """
    links = land(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .where("u <> v").distinct(), "links")
    seen = None
    while not is_empty(links):
        links = land(_small_star(_large_star(links)), "links")
        state = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v") % 1_000_003)).first())
        if state == seen:
            break
        seen = state
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _large_star(links: DataFrame) -> DataFrame:
    """Neighbours larger than a node go under the smallest of its neighbourhood."""
    both = links.union(links.select(F.col("v"), F.col("u")))
    low = land(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "low")
    return (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go under the smallest of them."""
    links = land(links, "links")
    low = land(links.groupBy("u").agg(F.min("v").alias("m")), "low")
    down = links.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
