"""Connected components of any identifiers, by alternating large-star and small-star steps.

Every step is a minimum per node, combined before its shuffle, and an equi-join back. Minima and
edges are written in each round, so hubs can be split and nothing is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of ``links`` (a, b): the smallest node that it reaches. Links with a null end do not
    count; a loop makes its node a component."""
    whole = links.select("a", "b").filter("a is not null and b is not null")
    alone = whole.filter("a = b").select(F.col("a").alias("node"))
    edges = materialise(whole.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "components")
    before = None
    while (now := _summary(edges)) != before:
        before = now
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
        low = materialise(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "components")
        large = materialise(both.join(low, "u").filter("v > u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "components")
        least = materialise(large.groupBy("b").agg(F.min("a").alias("m")), "components")
        pairs = F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))
        edges = materialise(large.join(least, "b").select(F.explode(pairs).alias("e")).select("e.a", "e.b").filter("a < b").distinct(), "components")
    found = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    loops = alone.distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return materialise(found.unionByName(loops), "components")


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
