"""Connected components by alternating large-star and small-star over DataFrames of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.frames import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    """Each neighbour above a node is joined to the least of the node and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are joined to the least of them; links go down from a to b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _ends(links: DataFrame) -> bool:
    """Whether every node has one link down at most, and nothing below that."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id on a link of columns a, b, the least id reachable. Links with a null or to themselves count for nothing.

    Each round is two stars whose joins have one row for a node on one side, so a hub's links can be split over tasks; it
    ends when every component is a star around its least id, after O(log^2 n) rounds. A round's table goes when the next
    one stands.
    """
    scratch = Scratch(links.sparkSession, "components")
    down = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, k = scratch.keep(down, "0"), 0
    while not _ends(now):
        now, k = scratch.keep(_small_star(_large_star(now)), str(k + 1)), k + 1
        scratch.drop(str(k - 1))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
