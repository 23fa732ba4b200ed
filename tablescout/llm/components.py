"""Connected components of a set of links by alternating large-star and small-star steps.

Every step is two joins over stored tables; per node only the smallest neighbour is kept, reduced in the map
tasks first, so neither a large component nor a node with very many links meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.session import discard, durable


def _stored(edges: DataFrame) -> DataFrame:
    return durable(edges.where("u != v").distinct())


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node points to one smaller node, and none of those points on."""
    several = edges.groupBy("u").count().where("count > 1")
    chained = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
    return several.isEmpty() and chained.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of the links ``u, v``; the component is its smallest node."""
    edges = _stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while not _only_stars(edges):
        # Large star: every larger neighbour of u is tied to the smallest node around u.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        tied = _stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        discard(edges, low)
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        low = durable(tied.groupBy("u").agg(F.min("v").alias("m")))
        small = tied.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = _stored(small.unionByName(low.select("u", F.col("m").alias("v"))))
        discard(tied, low)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
