"""Connected components by alternating large-star and small-star steps.

Each step is a minimum per node (combined before its shuffle) and an equi-join back; no
neighbourhood is ever collected. The minima are written before they are joined, so that
adaptive execution can split the rows of a hub; so is every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches), for every node of ``edges`` (a, b); loops are ignored."""
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    stamp = _stamp(edges)
    while stamp[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = materialise(both.join(low, "u").filter("v > u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "large-star")
        least = materialise(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        joined = large.join(least, "b")
        small = joined.select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").filter("a < b").distinct()
        edges = materialise(small, "edges")
        before, stamp = stamp, _stamp(edges)
        if before == stamp:
            break
    roots = edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    return materialise(roots.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()), "components")
