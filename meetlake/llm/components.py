"""Connected components of a graph given as links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetlake.llm.shared import staged


def _least(links: DataFrame) -> DataFrame:
    """For every node, the least of itself and its neighbours; added up before the shuffle, so a hub is one row a task."""
    return links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = down.join(_least(down), "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        joined.select("a", F.col("m").alias("b")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node that it reaches. Loops are ignored.

    Each round is written to the shared folder; the links stay as many as they were or fewer. The round count grows with
    the logarithm of the graph; more than ``rounds`` raises an error instead of returning parts.
    """
    now = staged(links.select("a", "b").where("a <> b").distinct(), "links")
    for _ in range(rounds):
        now = staged(_small_star(_large_star(now)).where("a <> b").distinct(), "links")
        # done when every link points to a node that points nowhere itself
        if now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"no end of the components after {rounds} rounds")
