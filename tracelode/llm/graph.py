"""Connected components of a large graph: alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that is no root itself; root is the least node it reaches.

    Each step ties a node's neighbours to the least of them. A node with very
    many neighbours is a minimum by partial aggregation and a join whose large
    partitions Spark splits; its neighbours are never gathered. The number of
    steps grows with the logarithm of the longest path; the tables between
    steps are in the shared folder.
    """
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.keep(small.unionByName(lower.withColumnRenamed("m", "v")).distinct())
        scratch.drop(edges)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = now
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
