"""Merging one knowledge base into another: raw sources by content and id, snapshots, carried-over nodes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import materialise


def merge_raw(main: DataFrame, other: DataFrame) -> DataFrame:
    """main, other: id, sha256 -> id, final_id, action of every source of ``other``: dropped (same content), renamed or moved.

    The free suffix is the smallest n from 2 for which ``<id>-n`` is taken by no source, be it of ``main`` or moved from
    ``other``; the taken suffixes of the ids that clash come from one equi-join on the stem.
    """
    by_sha = main.groupBy("sha256").agg(F.max("id").alias("same_id"))
    placed = other.join(by_sha, "sha256", "left").join(main.select("id", F.lit(True).alias("taken")).distinct(), "id", "left")
    clash = F.col("taken").isNotNull()
    renamed = placed.filter(F.col("same_id").isNull() & clash).select("id").distinct()
    ids = main.select("id").union(placed.filter(F.col("same_id").isNull() & ~clash).select("id"))
    free = free_names(renamed.select(F.col("id").alias("identifier")), ids.select(F.col("id").alias("identifier")), "-", "").select(F.col("identifier").alias("id"), "name")
    final = F.when(F.col("same_id").isNotNull(), F.col("same_id")).when(clash, F.col("name")).otherwise(F.col("id"))
    action = F.when(F.col("same_id").isNotNull(), "dropped").when(clash, "renamed").otherwise("moved")
    return placed.join(free, "id", "left").select("id", final.alias("final_id"), action.alias("action"))


def free_names(wanted: DataFrame, taken: DataFrame, before: str, after: str) -> DataFrame:
    """identifier, name for every identifier of ``wanted``: it, ``before``, the smallest number from 2 with which no
    identifier of ``taken`` ends so, and ``after``."""
    wanted = wanted.select("identifier").distinct()
    numbered = rf"^([\s\S]*){re.escape(before)}([2-9]|[1-9][0-9]{{1,17}}){re.escape(after)}$"
    of = lambda group: F.regexp_extract("identifier", numbered, group)
    used = taken.filter(F.col("identifier").rlike(numbered)).select(of(1).alias("identifier"), of(2).cast("long").alias("n")).join(wanted, "identifier", "left_semi").distinct()
    # The first number k places on that is not k + 1 has a gap before it.
    nth = F.row_number().over(Window.partitionBy("identifier").orderBy("n"))
    free = used.withColumn("unbroken", F.col("n") == nth + 1).groupBy("identifier").agg((F.count_if("unbroken") + 2).alias("free"))
    return wanted.join(free, "identifier", "left").select("identifier", F.concat("identifier", F.lit(before), F.coalesce("free", F.lit(2)).cast("string"), F.lit(after)).alias("name"))


def rewrite_raw_source(nodes: DataFrame, id_map: DataFrame) -> DataFrame:
    """raw_source paths of nodes follow the id map (id, final_id)."""
    old = F.regexp_extract("raw_source", "^raw/([^/]+)/", 1)
    joined = nodes.withColumn("_old", old).join(id_map.select(F.col("id").alias("_old"), "final_id"), "_old", "left")
    return joined.withColumn("raw_source", F.when(F.col("final_id").isNotNull(), F.concat(F.lit("raw/"), F.col("final_id"), F.expr("substring(raw_source, length(_old) + 5)"))).otherwise(F.col("raw_source"))).drop("_old", "final_id")


def snapshot(nodes: DataFrame) -> DataFrame:
    """identifier, path; of rows that share an identifier the last in file order, which follows from the paths as they are."""
    return nodes.groupBy("identifier").agg(F.max_by("path", T.file_order(F.col("path"))).alias("path"))


def write_snapshot(nodes: DataFrame, folder: str) -> None:
    """What ``verify_snapshot`` compares with after a merge."""
    snapshot(nodes).write.mode("errorifexists").parquet(folder)


def verify_snapshot(before: DataFrame, nodes: DataFrame) -> DataFrame:
    """identifier, issue: what was removed, or moved to another path."""
    now = snapshot(nodes).select("identifier", F.col("path").alias("new_path"))
    issue = F.when(F.col("new_path").isNull(), "removed").when(F.col("new_path") != F.col("path"), "moved")
    return before.join(now, "identifier", "left").select("identifier", issue.alias("issue")).filter("issue is not null")


def carry_over(main: DataFrame, other: DataFrame) -> DataFrame:
    """Nodes of ``main``, and those of ``other`` that match none by identifier."""
    return main.unionByName(other.join(main.select("identifier"), "identifier", "left_anti"), allowMissingColumns=True)


def candidates(main: DataFrame, other: DataFrame) -> DataFrame:
    """identifier pairs (main_id, other_id) that share a name (identifier or synonym, case folded) or an external reference."""
    none = F.array().cast("array<string>")

    def names(df: DataFrame) -> DataFrame:
        lists = [F.array("identifier")] + [F.coalesce(F.col(c), none) for c in ("synonyms",) if c in df.columns]
        named = F.transform(F.flatten(F.array(*lists)), lambda s: F.concat(F.lit("name "), F.lower(s)))
        refs = F.split(F.col("xref"), ", *") if "xref" in df.columns and dict(df.dtypes)["xref"] == "string" else (F.col("xref") if "xref" in df.columns else none)
        return df.select("identifier", F.explode(F.array_distinct(F.concat(named, F.coalesce(F.transform(refs, lambda x: F.concat(F.lit("xref "), x)), none)))).alias("name"))

    return names(main).withColumnRenamed("identifier", "main_id").join(names(other).withColumnRenamed("identifier", "other_id"), "name").select("main_id", "other_id").distinct()


def unite_sources(main: DataFrame, other: DataFrame, matches: DataFrame) -> DataFrame:
    """``main`` with the raw paths and external references (arrays raw_sources, xrefs) of what matches it in ``other``:
    matches is (old, new), old of ``other`` and new of ``main``."""
    theirs = other.join(matches, other.identifier == matches.old).groupBy("new").agg(F.flatten(F.collect_list("raw_sources")).alias("_raw"), F.flatten(F.collect_list("xrefs")).alias("_xrefs"))
    joined = main.join(theirs, main.identifier == theirs.new, "left")
    none = F.array().cast("array<string>")
    both = lambda c, more: F.array_union(F.coalesce(c, none), F.coalesce(more, none)).alias(c)
    return joined.select(*(c for c in main.columns if c not in ("raw_sources", "xrefs")), both("raw_sources", "_raw"), both("xrefs", "_xrefs"))


def renamed(main: DataFrame, other: DataFrame, matches: DataFrame, before: str = " (", after: str = ")") -> DataFrame:
    """old, new: identifiers of ``other`` that ``main`` uses for something else (no match), with the name they get: the
    first number from 2 that gives one that neither base uses."""
    clash = other.select("identifier").distinct().join(main.select("identifier"), "identifier", "left_semi").join(matches.select(F.col("old").alias("identifier")), "identifier", "left_anti")
    free = free_names(clash, main.select("identifier").union(other.select("identifier")), before, after)
    return free.select(F.col("identifier").alias("old"), F.col("name").alias("new"))


def harmonised(nodes: DataFrame) -> DataFrame:
    """Spellings of one subtype within a type become the most frequent of them (of equals the first)."""
    folded = F.lower(F.regexp_replace("subtype", "[^A-Za-z0-9]", ""))
    used = nodes.filter("subtype is not null").groupBy("node_type", folded.alias("_folded"), "subtype").agg(F.count(F.lit(1)).alias("n"))
    best = used.groupBy(F.col("node_type").alias("_type"), "_folded").agg(F.min(F.struct((-F.col("n")).alias("n"), "subtype")).alias("_b")).select("_type", "_folded", F.col("_b.subtype").alias("_best"))
    out = nodes.withColumn("_of", folded).join(best, (F.col("node_type") == F.col("_type")) & (F.col("_of") == F.col("_folded")), "left")
    return out.withColumn("subtype", F.coalesce("_best", "subtype")).drop("_of", "_type", "_folded", "_best")


def collapse(edges: DataFrame, matches: DataFrame) -> DataFrame:
    """References of edges follow a match table (old, new) on object and primary source. Matches are written first, so that
    a short table is sent to the edges, and hot references are split where it is long."""
    matches = materialise(matches.select("old", "new"), "matches")
    obj = matches.select(F.col("old").alias("object"), F.col("new").alias("_o"))
    src = matches.select(F.col("old").alias("primary_source"), F.col("new").alias("_s"))
    out = edges.join(obj, "object", "left").join(src, "primary_source", "left")
    return out.withColumn("object", F.coalesce("_o", "object")).withColumn("primary_source", F.coalesce("_s", "primary_source")).select(*edges.columns)
