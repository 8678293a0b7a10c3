"""Connected components of links between nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadwave.llm.common import stash


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node that can be reached.

    Rounds until every node has one edge, to a root that has none: large-star and small-star steps, each two aggregations to a minimum and joins back, so that a hub of any degree
    is only an aggregation key. Every round is written to the shared folder. Links with a missing end are left out.
    """
    a, b = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = stash(links.where("a is not null and b is not null and a != b").select(a, b).distinct(), "edges")
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.where("v > u").join(least, "u").where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = stash(small.union(least.select("u", F.col("least").alias("v"))).distinct(), "edges")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of the edges (u, v), v < u, is either u of one edge or v of any number."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    degrees = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not degrees.agg(F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()[0]
