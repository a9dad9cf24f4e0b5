"""Graph derivation: oriented edges, synthesised provenance edges, external stubs, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..sources.tables import materialise


def oriented(edges: DataFrame) -> DataFrame:
    """source, target, predicate of every authored edge; inverse ones are flipped."""
    return edges.select(
        F.when(F.col("reversed"), F.col("object")).otherwise(F.col("subject")).alias("source"),
        F.when(F.col("reversed"), F.col("subject")).otherwise(F.col("object")).alias("target"),
        "predicate",
        F.lit(False).alias("synthesized"),
    )


def synthesized(edges: DataFrame) -> DataFrame:
    """A reported_in edge from each subject to each primary source, once per pair, unless one is authored: one pass and
    one shuffle of the pairs, combined before it."""
    wanted = F.expr("primary_source is not null and primary_source <> 'not_provided' and primary_source <> subject")
    pair = lambda target, authored: F.struct(F.col(target).alias("target"), F.lit(authored).alias("authored"))
    pairs = F.array(F.when(wanted, pair("primary_source", False)), F.when(F.col("predicate") == "reported_in", pair("object", True)))
    each = edges.select(F.col("subject").alias("source"), F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("p")).select("source", "p.target", "p.authored")
    made = each.groupBy("source", "target").agg(F.bool_or("authored").alias("authored")).filter("not authored")
    return made.select("source", "target", F.lit("reported_in").alias("predicate"), F.lit(True).alias("synthesized"))


def graph_edges(edges: DataFrame) -> DataFrame:
    return oriented(edges).unionByName(synthesized(edges))


def externals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Stubs for objects and primary sources that no node bears: identifier, once each."""
    named = edges.select(F.col("object").alias("identifier")).union(synthesized(edges).select(F.col("target").alias("identifier")))
    return named.distinct().join(nodes.select("identifier"), "identifier", "left_anti")


def ends(edges: DataFrame) -> DataFrame:
    """identifier, degree over all graph edges, and named (an object or the source of a made edge); a loop counts twice.
    Each end is counted before the shuffle, so a hub is combined early."""
    end = lambda c, n, named: F.struct(F.col(c).alias("identifier"), F.lit(n).cast("long").alias("n"), F.lit(named).alias("named"))
    authored = edges.select(F.explode(F.array(end("subject", 1, False), end("object", 1, True))).alias("e"))
    made = synthesized(edges).select(F.explode(F.array(end("source", 1, False), end("target", 1, True))).alias("e"))
    return authored.unionByName(made).groupBy("e.identifier").agg(F.sum("e.n").alias("degree"), F.bool_or("e.named").alias("named"))


def degrees(edges: DataFrame) -> DataFrame:
    """identifier, degree."""
    return ends(edges).select("identifier", "degree")


def graph_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """identifier, node_type, family, external, degree. Of rows that share an identifier, the last in file order has the
    degree. Ends that no node bears are stubs, if an edge names them as object or source."""
    last = nodes.groupBy("identifier").agg(F.max("file_ord").alias("last"))
    real = nodes.select("identifier", "node_type", "family", "file_ord").join(last, "identifier")
    found = real.withColumnRenamed("identifier", "own").join(ends(edges), F.col("own") == F.col("identifier"), "full").filter("own is not null or named")
    external, degree = F.col("own").isNull(), F.coalesce("degree", F.lit(0).cast("long"))
    return found.select(
        F.coalesce("own", "identifier").alias("identifier"),
        F.when(external, "External").otherwise(F.col("node_type")).alias("node_type"),
        F.when(external, "external").otherwise(F.col("family")).alias("family"),
        external.alias("external"),
        F.when(external | (F.col("file_ord") == F.col("last")), degree).otherwise(F.lit(0).cast("long")).alias("degree"),
    )


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """identifier, node_type of nodes without an edge; of rows that share an identifier only the last can have one. Which
    edges are made does not matter here: what they would join are ends already."""
    named = F.expr("primary_source is not null and primary_source <> 'not_provided'")
    touched = edges.select(F.explode(F.array_distinct(F.filter(F.array("subject", "object", F.when(named, F.col("primary_source"))), lambda x: x.isNotNull()))).alias("touched")).distinct()
    last = nodes.groupBy("identifier").agg(F.max("file_ord").alias("last"))
    found = nodes.select("identifier", "node_type", "file_ord").join(last, "identifier").join(touched, F.col("identifier") == F.col("touched"), "left")
    return found.filter("touched is null or file_ord <> last").select("identifier", "node_type")


def adjacency(edges: DataFrame) -> DataFrame:
    """identifier, neighbor, predicate in both directions; authored edges only."""
    o = oriented(edges)
    return o.select(F.col("source").alias("identifier"), F.col("target").alias("neighbor"), "predicate").union(o.select(F.col("target").alias("identifier"), F.col("source").alias("neighbor"), "predicate"))


def neighbors(edges: DataFrame, identifier: str) -> DataFrame:
    """neighbor, n: the one-hop focus of a node."""
    return adjacency(edges.filter((F.col("subject") == identifier) | (F.col("object") == identifier))).filter(F.col("identifier") == identifier).groupBy("neighbor").agg(F.count(F.lit(1)).alias("n"))


def node_panel(edges: DataFrame, identifier: str) -> DataFrame:
    """direction, predicate, n: outgoing by predicate, and referenced-by."""
    g = graph_edges(edges)
    out = g.filter(F.col("source") == identifier).select(F.lit("out").alias("direction"), "predicate")
    into = g.filter(F.col("target") == identifier).select(F.lit("in").alias("direction"), "predicate")
    return out.union(into).groupBy("direction", "predicate").agg(F.count(F.lit(1)).alias("n"))


def two_hop(edges: DataFrame, first: str, second: str) -> DataFrame:
    """start, finish, n_paths over two predicates in a row, with the best knowledge level of the first, by rank: levels
    rank in the order of the vocabulary, and one outside it, or none, last. Steps are counted by their ends before they
    meet, so a hot middle joins counts, not edges."""
    hop = lambda predicate: edges.filter(F.col("predicate") == predicate)
    a = hop(first).groupBy(F.col("subject").alias("start"), F.col("object").alias("middle")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(level_rank("knowledge_level").alias("rank"), "knowledge_level")).alias("best"))
    b = hop(second).groupBy(F.col("subject").alias("middle"), F.col("object").alias("finish")).agg(F.count(F.lit(1)).alias("m"))
    return a.join(b, "middle").groupBy("start", "finish").agg(F.sum(F.col("n") * F.col("m")).alias("n_paths"), F.min("best")["knowledge_level"].alias("level"))


def level_rank(level: str) -> Column:
    """Place of a knowledge level in the vocabulary."""
    place = F.array_position(F.array(*map(F.lit, vocab.KNOWLEDGE_LEVELS)), F.col(level))
    return F.when(place > 0, place).otherwise(F.lit(len(vocab.KNOWLEDGE_LEVELS) + 1)).cast("long")


def edge_ordinals(edges: DataFrame) -> DataFrame:
    """edge_ord within each subject, over all columns, so that the order is total.

    Edges are dealt out by ranges of that order, so that a hub's edges lie in several parts, and are written; each part
    numbers its own, and what a subject has in earlier parts is added.
    """
    keys = ["raw_predicate", "object", "primary_source", "knowledge_level", "agent_type", "direction", "ci_lower", "ci_upper", "p_value", "negated_flag"]
    order = [F.col(c).asc_nulls_first() for c in keys]
    parts = materialise(edges.repartitionByRange("subject", *order).withColumn("_part", F.spark_partition_id()), "edge-parts")
    sizes = parts.groupBy("subject", "_part").agg(F.count(F.lit(1)).alias("_n"))  # few rows for each subject: one for each part
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("subject").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = materialise(sizes.withColumn("_before", earlier).filter("_before > 0").select(F.col("subject").alias("_of"), F.col("_part").alias("_in"), "_before"), "earlier-edges")
    numbered = parts.withColumn("_nth", F.row_number().over(Window.partitionBy("subject", "_part").orderBy(*order)))
    out = numbered.join(before, (F.col("subject") == F.col("_of")) & (F.col("_part") == F.col("_in")), "left")
    return out.withColumn("edge_ord", F.coalesce("_before", F.lit(0)) + F.col("_nth")).drop("_part", "_of", "_in", "_before", "_nth")
