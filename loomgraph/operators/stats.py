"""Counts and catalogues over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import materialise


def by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return count(nodes, "nodes").union(count(edges, "edges"))


def catalog_by_type(nodes: DataFrame) -> DataFrame:
    """node_type, n, first and last identifier; the members themselves are ``members_by_type``'s rows."""
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.min("identifier").alias("first_id"), F.max("identifier").alias("last_id"))


def members_by_type(nodes: DataFrame) -> DataFrame:
    """node_type, identifier, description as shown: description, else note, else the first line of the body that is neither
    blank nor a heading; one line of at most 80 characters."""
    texts = [F.col("description"), F.col("note")]
    if "body" in nodes.columns:
        lines = F.transform(F.split("body", "\r?\n"), T.strip)
        texts.append(F.get(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), 0))
    return nodes.select("node_type", "identifier", T.strip(F.left(F.translate(F.coalesce(*texts, F.lit("")), "\n|", "  "), F.lit(80))).alias("shown"))


def subtypes_in_use(nodes: DataFrame) -> DataFrame:
    return nodes.filter("subtype is not null").select("node_type", "subtype").distinct()


def similar_subtypes(nodes: DataFrame) -> DataFrame:
    """node_type, folded form, number of spellings, where more than one spelling is in use."""
    folded = F.lower(F.regexp_replace("subtype", "[^A-Za-z0-9]", ""))
    return subtypes_in_use(nodes).groupBy("node_type", folded.alias("folded")).agg(F.count(F.lit(1)).alias("n_spellings"), F.array_join(F.sort_array(F.collect_set("subtype")), ", ").alias("spellings")).filter("n_spellings > 1")


def edge_subtypes(edges: DataFrame) -> DataFrame:
    """subtype: the distinct text values under that key of edges' further properties (JSON)."""
    value = F.try_element_at("stats", F.lit("subtype"))
    return edges.select(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v").alias("subtype")).filter(value.startswith('"')).distinct()


#: Characters of an identifier by which it is looked up among the lines of an index.
GRAM = 6


def index_missing(nodes: DataFrame, index: DataFrame) -> DataFrame:
    """Identifiers that do not occur, even as part of a word, in any line of an index (column line).

    An identifier can only stand in a line that has all its runs of GRAM characters; one of up to GRAM characters is such a
    run itself. Only those whose first run is in some line are cut up. They are joined with the lines that have the rarest
    of their runs, by an equi-join, and looked for there. Runs and lines meet as 64-bit hashes, so that shuffles and
    aggregates hold numbers; what hashes bring together the texts decide.
    """
    ids = materialise(nodes.select("identifier").distinct().filter("identifier <> ''"), "identifiers")
    lines = materialise(index.select("line").distinct().withColumn("at", F.xxhash64("line")), "index-lines")
    runs = lambda c, n: F.transform(F.sequence(F.lit(1), F.char_length(c) - n + 1), lambda i: F.xxhash64(F.substr(c, i, n)))
    size = F.least(F.char_length("identifier"), F.lit(GRAM))
    line, sizes = F.col("line"), [r[0] for r in ids.select(size).distinct().collect()] or [GRAM]  # at most GRAM rows
    every = F.flatten(F.array(*(F.when(F.char_length(line) >= n, runs(line, F.lit(n))).otherwise(F.array().cast("array<bigint>")) for n in sizes)))
    placed = lines.select("at", F.explode(F.array_distinct(every)).alias("gram"))
    begun = ids.select("identifier", F.xxhash64(F.substr(F.col("identifier"), F.lit(1), size)).alias("gram"))
    firsts = materialise(placed.select("gram").join(begun.select("gram").distinct(), "gram", "left_semi").distinct(), "first-runs")
    some = begun.join(firsts, "gram", "left_semi").select("identifier")
    wanted = materialise(some.select("identifier", F.explode(F.array_distinct(runs(F.col("identifier"), size))).alias("gram")), "identifier-runs")
    # The runs of all lines are many times those that are asked for: a hash table of the latter saves sorting the former.
    found = materialise(placed.join(wanted.select("gram").distinct().hint("shuffle_hash"), "gram", "left_semi"), "index-runs")
    counts = materialise(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "index-counts")
    each = wanted.join(counts, "gram", "left").select("identifier", "gram", F.coalesce("n", F.lit(0)).alias("n"))
    rarest = each.groupBy("identifier").agg(F.min("n").alias("n"), F.min_by("gram", "n").alias("gram"))  # not of a struct, which is sorted for
    rarest = materialise(rarest.filter("n > 0").select("identifier", "gram"), "rarest-runs")
    there = rarest.join(found, "gram").join(lines, "at").filter(F.contains("line", "identifier")).select("identifier")
    return ids.join(there.distinct(), "identifier", "left_anti")
