"""Sinks: the graph, the index and the change log as rows of text or JSON, written by Spark in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise
from . import graph, stats


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON value per node and edge: a graph of any size goes out in parallel, as JSON lines."""
    n = graph.graph_nodes(nodes, edges).select(F.to_json(F.struct(F.lit("node").alias("kind"), "identifier", "node_type", "family", "external", "degree")).alias("json"))
    e = graph.graph_edges(edges).select(F.to_json(F.struct(F.lit("edge").alias("kind"), "source", "target", "predicate", "synthesized")).alias("json"))
    return n.union(e)


def bundle_json(nodes: DataFrame, edges: DataFrame, bundle_id: str, name: str | None = None, log: str = "", findings: DataFrame | None = None, pages: bool = True) -> DataFrame:
    """A whole bundle as JSON lines: a header (id, name, counts of nodes and authored edges, date of the newest log entry,
    log), the graph, a line for each page (without them the header says that they are deferred), and the findings."""
    updated = F.nullif(F.trim(F.regexp_extract(F.lit(log), r"(?m)^[ \t]*## [ \t]*(\S.*)$", 1)), F.lit(""))
    counts = nodes.agg(F.count(F.lit(1)).alias("node_count")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edge_count")))  # one row each
    deferred = [] if pages else [F.lit(True).alias("pages_deferred")]
    head = counts.select(F.to_json(F.struct(F.lit("bundle").alias("kind"), F.lit(bundle_id).alias("id"), F.lit(name or bundle_id).alias("name"), "node_count", "edge_count", updated.alias("updated"), F.lit(log).alias("log"), *deferred)).alias("json"))
    out = head.union(graph_json(nodes, edges))
    if pages:
        out = out.union(nodes.select(F.to_json(F.struct(F.lit("page").alias("kind"), *nodes.columns)).alias("json")))
    if findings is not None:
        out = out.union(findings.select(F.to_json(F.struct(F.lit("finding").alias("kind"), *findings.columns)).alias("json")))
    return out


def index_rows(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """section, ord, line of an index: the registry of identifiers, the catalogue by type, the subtypes in use (of edges
    too, where edges have further properties). Ordered by section and ord they are its text."""
    esc = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    order = F.col("file_ord") if "file_ord" in nodes.columns else F.col("path")
    shown = stats.members_by_type(nodes.withColumn("node_type", F.struct("node_type", "subtype", order.alias("at"))))
    line = F.concat(F.lit("| "), esc(F.col("identifier")), F.lit(" | "), F.col("node_type.node_type"), F.lit(" | "), esc(F.col("node_type.subtype")), F.lit(" | "), F.col("shown"), F.lit(" |"))
    at = lambda *c: F.concat_ws("\t", *c)
    registry = shown.select(F.lit(1).alias("section"), at("identifier", "node_type.at").alias("ord"), line.alias("line"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_list(c)), ", ")
    # A type's identifiers stand in one line, as the format wants it; stats.members_by_type has them as rows.
    by_type = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), joined("identifier").alias("ids"))
    catalogue = by_type.select(F.lit(2).alias("section"), F.col("node_type").alias("ord"), F.concat(F.lit("- **"), "node_type", F.lit("** ("), F.col("n").cast("string"), F.lit("): "), "ids").alias("line"))
    used = stats.subtypes_in_use(nodes).groupBy("node_type").agg(joined("subtype").alias("all"))
    subtypes = used.select(F.lit(3).alias("section"), F.col("node_type").alias("ord"), F.concat(F.lit("- **"), "node_type", F.lit("**: "), "all").alias("line"))
    out = registry.union(catalogue).union(subtypes)
    if edges is not None and "stats" in edges.columns:
        of_edges = stats.edge_subtypes(edges).agg(joined("subtype").alias("all")).filter("all <> ''")
        out = out.union(of_edges.select(F.lit(4), F.lit(""), F.concat(F.lit("- **edges**: "), "all")))
    return out


HEADS = {1: "## Identifier registry\n\n| identifier | type | subtype | description |\n|---|---|---|---|\n", 2: "\n## By type\n\n", 3: "\n## Subtypes in use\n\n", 4: ""}


def index_text(rows: DataFrame) -> DataFrame:
    """One row, text: the block of an index. An index is one page; rows of larger bases are written by ``write_text``."""
    lines = F.array_sort(F.collect_list(F.struct("section", "ord", "line")))
    part = lambda n: F.concat(F.lit(HEADS[n]), F.array_join(F.transform(F.filter("lines", lambda x: x["section"] == n), lambda x: F.concat(x["line"], F.lit("\n"))), ""))
    return rows.agg(lines.alias("lines")).select(F.concat(*(part(n) for n in HEADS)).alias("text"))


def upserted(existing: Column, block: Column, start: str, end: str, name: str = "index") -> Column:
    """An index page with the block between its two marks: what stands between them is replaced; a page without them gets
    the block at its end, and an empty one a heading."""
    page, whole = F.coalesce(existing, F.lit("")), F.concat(F.lit(start + "\n"), block, F.lit(end + "\n"))
    first, last = F.locate(start, page), F.locate(end, page)
    kept = F.concat(F.substr(page, F.lit(1), first - 1), whole, F.substr(page, last + len(end)))
    fresh = F.concat(F.lit(f"# {name}\n\n"), whole)
    return F.when((first > 0) & (last >= first), kept).when(F.trim(page) == "", fresh).otherwise(F.concat(F.rtrim(page, F.lit(" \t\r\n")), F.lit("\n\n"), whole))


def log_with(existing: Column, date: Column, kind: Column, summary: Column, delta: Column) -> Column:
    """A change log with a new entry, newest first: right below its title."""
    log = F.coalesce(existing, F.lit("# Change log\n"))
    entry = F.concat(F.lit("\n## "), date, F.lit("\n\n"), kind, F.lit(" | "), summary, F.lit("\n"), F.coalesce(F.concat(F.lit("\n"), delta, F.lit("\n")), F.lit("")))
    title = F.locate("\n", log)
    return F.when(title > 0, F.concat(F.substr(log, F.lit(1), title), entry, F.substr(log, title + 1))).otherwise(F.concat(log, entry))


def log_sync(history: DataFrame, logs: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History rows to append, and the logs with the same entries, from one written table of changes, so that the two never
    differ. changes: bundle, commit, at, kind, summary, delta, one for each bundle; logs: bundle, text."""
    once = materialise(changes, "changes")
    of = once.select(F.col("bundle").alias("_bundle"), F.date_format("at", "yyyy-MM-dd").alias("_day"), "kind", "summary", "delta")
    new = of.join(logs, of._bundle == logs.bundle, "left").select(F.col("_bundle").alias("bundle"), log_with(F.col("text"), F.col("_day"), F.col("kind"), F.col("summary"), F.col("delta")).alias("text"))
    return once.select(*(c for c in history.columns if c in once.columns)), new


def write_text(df: DataFrame, path: str, column: str = "json") -> None:
    df.select(column).write.mode("errorifexists").text(path)
