"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import join_shuffled, written


def _large(edges: DataFrame) -> DataFrame:
    """Joins every node's larger neighbours to its least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return join_shuffled(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Joins every node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = join_shuffled(edges, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v")))


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """links: u, v (long). Returns node, root: the least node reachable, for every node that isn't its own root.

    Each step's edges are written to the shared folder, so lineage stays short; the number of steps grows with the logarithm
    of the longest path. Nothing but counts reaches the driver.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    seen = _print(edges)
    while seen[0]:
        edges = written(_small(_large(edges).distinct()).distinct(), label)
        now = _print(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
