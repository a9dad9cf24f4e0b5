"""One base merged onto another: transitive groups of matches, free names, rewritten references, kept contradictions.

The main base is canonical. Matches may chain (a of the one base matches x and y of the other):
what they connect is one group, which takes the smallest identifier of the main base in it. A
node of the other base whose identifier the main base uses for something else is renamed. The
resulting map is a table of (origin, identifier), and every reference is rewritten by equi-joins
with the rows of it that change something, which are written first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise
from . import merge
from .components import components

MAIN, OTHER = "main", "other"


def _types(nodes: DataFrame) -> DataFrame:
    """identifier, node_type; of rows that share an identifier the first in file order."""
    return nodes.groupBy("identifier").agg(F.min_by("node_type", "file_ord").alias("node_type"))


def merge_map(main: DataFrame, other: DataFrame, matches: DataFrame, before: str = " (", after: str = ")") -> DataFrame:
    """origin, identifier, final, action (kept, collapsed, renamed, carried) for every identifier of both bases (identifier,
    node_type, file_ord). matches: old (of ``other``), new (of ``main``).

    A match counts where both exist and are of one type: facets of different types stay apart.
    """
    ours, theirs = (materialise(_types(df), "merge-types") for df in (main, other))
    pair = matches.select("old", "new").distinct()
    typed = pair.join(ours.select(F.col("identifier").alias("new"), F.col("node_type").alias("_t")), "new").join(theirs.select(F.col("identifier").alias("old"), F.col("node_type").alias("_u")), "old").filter("_t = _u")
    # The main base's letter sorts first, so a group's smallest node is one of the main base.
    links = typed.select(F.concat(F.lit("a"), "new").alias("a"), F.concat(F.lit("b"), "old").alias("b"))
    found = components(links).select(F.left("node", F.lit(1)).alias("letter"), F.expr("substring(node, 2)").alias("identifier"), F.expr("substring(component, 2)").alias("group"))
    group = lambda letter: found.filter(F.col("letter") == letter).drop("letter")
    kept = ours.select("identifier").join(group("a"), "identifier", "left").select(F.lit(MAIN).alias("origin"), "identifier", F.coalesce("group", "identifier").alias("final"), F.when(F.col("group") != F.col("identifier"), "collapsed").otherwise("kept").alias("action"))
    placed = materialise(theirs.select("identifier").join(group("b"), "identifier", "left").join(ours.select("identifier", F.lit(True).alias("taken")), "identifier", "left"), "placed")
    clash = F.col("group").isNull() & F.col("taken").isNotNull()
    free = merge.free_names(placed.filter(clash).select("identifier"), ours.select("identifier").unionByName(theirs.select("identifier")), before, after)
    final = F.coalesce("group", "name", "identifier")
    action = F.when(F.col("group").isNotNull(), "collapsed").when(F.col("name").isNotNull(), "renamed").otherwise("carried")
    moved = placed.join(free, "identifier", "left").select(F.lit(OTHER).alias("origin"), "identifier", final.alias("final"), action.alias("action"))
    return materialise(kept.unionByName(moved), "merge-map")


def _of_both(main: DataFrame, other: DataFrame) -> DataFrame:
    return main.withColumn("origin", F.lit(MAIN)).unionByName(other.withColumn("origin", F.lit(OTHER)), allowMissingColumns=True)


def _changes(final: DataFrame) -> DataFrame:
    return materialise(final.filter("final <> identifier").select(F.col("origin").alias("_origin"), F.col("identifier").alias("_id"), "final"), "merge-changes")


def _rewritten(df: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    joined = df.join(changes, (F.col("origin") == F.col("_origin")) & (F.col(column) == F.col("_id")), "left")
    return joined.withColumn(column, F.coalesce("final", column)).drop("_origin", "_id", "final")


def merged_edges(main: DataFrame, other: DataFrame, final: DataFrame) -> DataFrame:
    """The edges of both bases (nothing is made distinct) with origin, their subject, object and primary source as ``merge_map``
    says; a reference to what its base does not hold stays."""
    return rewritten(_of_both(main, other), final, ("subject", "object", "primary_source"))


def rewritten(edges: DataFrame, final: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Edges of both bases (origin) with the references in ``columns`` as ``merge_map`` says."""
    changes = _changes(final)
    for column in columns:
        edges = _rewritten(edges, changes, column)
    return edges


def contradictions(edges: DataFrame) -> DataFrame:
    """subject, predicate, object, positive, negative (the bases that say so) of merged edges that are both affirmed and
    denied; all of them stay."""
    said = lambda negative: F.array_sort(F.collect_set(F.when(F.col("negative") == F.lit(negative), F.col("origin"))))  # noqa: E731  two bases at most
    return edges.groupBy("subject", F.col("base").alias("predicate"), "object").agg(said(False).alias("positive"), said(True).alias("negative")).filter("size(positive) > 0 and size(negative) > 0")


def merged_nodes(main: DataFrame, other: DataFrame, final: DataFrame, scalars: list[str], lists: list[str] | None = None) -> DataFrame:
    """identifier, scalars, lists, also_known (the identifiers that collapsed into it), origins, path of every merged node.

    Of scalar values the first one given counts, the main base first, then file order (``scalar_conflicts`` has the others);
    lists are united.
    """
    lists = lists or []
    both = _of_both(main, other).join(final.select(F.col("origin").alias("_origin"), F.col("identifier").alias("_id"), "final"), (F.col("origin") == F.col("_origin")) & (F.col("identifier") == F.col("_id"))).drop("_origin", "_id")
    # A row whose identifier is the final one comes first, then main before other: both sort so as text.
    order = F.struct(F.col("identifier") != F.col("final"), "origin", "file_ord")
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in scalars]
    united = [F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))).alias(c) for c in lists]
    known = F.array_sort(F.collect_set(F.when((F.col("identifier") != F.col("final")), F.col("identifier")))).alias("also_known")
    out = both.groupBy("final").agg(*first, *united, known, F.array_sort(F.collect_set("origin")).alias("origins"), F.min_by("path", order).alias("path"))
    return out.withColumnRenamed("final", "identifier")


def scalar_conflicts(main: DataFrame, other: DataFrame, final: DataFrame, scalars: list[str]) -> DataFrame:
    """identifier, field, value, origin, source (the identifier it came from): every value of a field where a merged node was
    given several; all are told, each with where it comes from."""
    value = lambda c: F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
    both = _of_both(main, other).join(final.select(F.col("origin").alias("_origin"), F.col("identifier").alias("_id"), "final"), (F.col("origin") == F.col("_origin")) & (F.col("identifier") == F.col("_id")))
    given = materialise(both.select("final", "origin", "identifier", F.explode(F.array(*map(value, scalars))).alias("v")).select("final", "origin", "identifier", "v.field", "v.value").filter("value is not null").distinct(), "merge-values")
    several = materialise(given.groupBy("final", "field").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter("lo < hi").select("final", "field"), "merge-conflicts")
    return given.join(several, ["final", "field"], "left_semi").select(F.col("final").alias("identifier"), "field", "value", "origin", F.col("identifier").alias("source"))


def harmonised(nodes: DataFrame) -> DataFrame:
    """Merged ``nodes`` (node_type, subtype, origin) with equivalent subtypes of one type spelled as in the main base, or
    else as most rows of the other do (of equals the first)."""
    folded: Column = F.lower(F.regexp_replace("subtype", "[^A-Za-z0-9]", ""))
    used = nodes.filter("subtype is not null").groupBy("node_type", folded.alias("folded"), "subtype").agg(F.count(F.lit(1)).alias("n"), F.min("origin").alias("origin"))
    best = used.groupBy(F.col("node_type").alias("_type"), F.col("folded").alias("_folded")).agg(F.min(F.struct("origin", (-F.col("n")).alias("n"), "subtype"))["subtype"].alias("_best"))
    best = materialise(best, "subtype-names")
    out = nodes.withColumn("_of", folded).join(best, (F.col("node_type") == F.col("_type")) & (F.col("_of") == F.col("_folded")), "left")
    return out.withColumn("subtype", F.coalesce("_best", "subtype")).drop("_of", "_type", "_folded", "_best")
