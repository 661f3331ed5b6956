"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is an aggregate for the least neighbour and a join on it, so a node with very many links is
combined on the map side and never gathered. The link table is rewritten to shared storage in each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeweave.session import discard, written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select("b", "m").where("b <> m").toDF("a", "b").union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; the component is its least node. Nodes are longs without nulls.

    Self-links and repeated links do no harm. The loop ends when a round leaves the links as they were.
    """
    links = written(links.toDF("a", "b").where("a <> b").distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, old = state, links
        links = written(_small_star(_large_star(links)), "links")
        discard(old)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b")).distinct()
