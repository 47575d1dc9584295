"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm._shared import landed


def _star(near: DataFrame) -> DataFrame:
    """Each neighbour ``v`` in ``near`` (of ``u``) linked to the least neighbour of ``u``."""
    least = landed(near.groupBy("u").agg(F.min("v").alias("m")), "links-least")
    return near.join(least.withColumn("m", F.least("m", "u")), "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: every linked node with the least node it can reach.

    A large-star step hangs a node's larger neighbours under its least neighbour, a small-star step
    its smaller ones; each step is a grouping and a join, written to the shared folder, and their
    number grows with the logarithm of the longest chain. The neighbours of a node are never
    gathered in one row, and a join to a node with many links can be split.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    pairs = landed(pairs.distinct(), "links")
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = landed(large.filter("u <> v").distinct(), "links-large")
        joined = _star(large)
        small = joined.select("v", "m").unionByName(joined.select(F.col("u").alias("v"), "m"))
        pairs = landed(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "links-small",
        )
        # A star is reached when no node has two neighbours above it and none is both leaf and centre.
        centre = pairs.select(F.col("v").alias("u")).distinct()
        single = pairs.select("u").distinct().count() == pairs.count()
        if single and pairs.join(centre, "u", "left_semi").isEmpty():
            break
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(centres)
