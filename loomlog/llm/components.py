"""Connected components over links, in Spark.

Alternates the large-star and small-star steps: every node is linked to the smallest node among its
neighbours, until the links are stars: every node but the roots has one link, to a root. The rounds grow with the logarithm
of the size. Minima are taken with map-side combine, so a node with very many links is no hot group; each round is written to
the shared folder, and the one before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b; longs): component is its smallest reachable node."""
    edges, path = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _stars(edges):
        # large star: neighbours above u go to the smallest in u's neighbourhood, itself included
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()
        # small star: neighbours below u, and u, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v"))).filter("u <> v").distinct()
        before = path
        edges, path = written(small, "links")
        remove(links.sparkSession, before)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node with a link below it has just one, to a node that has none."""
    own = edges.groupBy("u").agg(F.count("*").alias("n"))
    if own.filter("n > 1").limit(1).count():
        return False
    return not edges.select("v").distinct().join(own.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
