"""All registered queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T
from ..operators import credibility, export, graph, history, ingest, lint, matching, merge, normalise, paths, relint, search, semantic, stats, trees, versions
from ..sources import adapter, tables
from . import oracle

Query = Callable[[SparkSession, str], DataFrame]


def n_rows() -> Column:
    return F.count(F.lit(1)).alias("n")


def N(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised nodes."""
    return normalise.normalise_nodes(adapter.file_order(adapter.with_raw_paths(adapter.nodes(spark, sf_dir))))


def E(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised edges."""
    return normalise.normalise_edges(adapter.edges(spark, sf_dir))


def _nodes(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(N(spark, d))


def _edges(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(E(spark, d))


def _both(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(N(spark, d), E(spark, d))


def _table(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(adapter.table(spark, d, name))


def _rule(name: str) -> Query:
    return lambda spark, d: lint.rule(name, N(spark, d), E(spark, d))


def _docs(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").alias("key"), "text")


def kb_ids(df: DataFrame) -> DataFrame:
    k = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))))
    return df.select("s_suppkey", T.kb_id_valid(k).alias("ok"))


def resolve_objects(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return lint.objects_resolved(nodes, edges).groupBy("predicate", F.coalesce("object_type", F.lit("External")).alias("object_type")).agg(n_rows())


def source_resolution(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    types = lint.node_types(nodes).select(F.col("identifier").alias("primary_source"), "is_provenance")
    joined = edges.filter("primary_source is not null and primary_source <> 'not_provided'").join(types, "primary_source", "left")
    return joined.groupBy(F.when(F.col("is_provenance").isNull(), "unresolved").when(F.col("is_provenance"), "ok").otherwise("not_source").alias("outcome")).agg(n_rows())


def cited(spark: SparkSession, d: str) -> DataFrame:
    return lint.cited_sources(N(spark, d), E(spark, d), adapter.sources(spark, d))


def index_lines(spark: SparkSession, d: str) -> DataFrame:
    """An index over the whole part table; a third of its lines name the part."""
    k = F.col("p_partkey")
    return adapter.table(spark, d, "part").select(F.concat(F.lit("| "), F.when(k % 3 == 0, "Part ").otherwise("P-"), k.cast("string"), F.lit(" | "), F.col("p_name"), F.lit(" |")).alias("line"))


def index_missing(spark: SparkSession, d: str) -> DataFrame:
    return stats.index_missing(N(spark, d), index_lines(spark, d))


def ordinals(edges: DataFrame) -> DataFrame:
    return graph.edge_ordinals(edges).groupBy("subject").agg(n_rows(), F.max("edge_ord").cast("long").alias("last_ord"))


def tokenize(df: DataFrame) -> DataFrame:
    toks = T.tokens(F.col("text"))
    return df.select("doc_id", F.size(toks).cast("long").alias("n_tokens"), F.size(F.array_distinct(toks)).cast("long").alias("n_terms"))


def ingest_dedup(spark: SparkSession, d: str) -> DataFrame:
    src = adapter.sources(spark, d).select("doc_id", "id", "sha256")
    out = ingest.deduplicate(src.filter("doc_id % 2 = 1").withColumn("ord", F.col("doc_id")), src.filter("doc_id % 2 = 0").select("id", "sha256"))
    return out.select("doc_id", "existing_id", "action")


def url_dedup(spark: SparkSession, d: str) -> DataFrame:
    p = adapter.pages(spark, d).select(F.col("page_id").alias("id"), "url", F.sha2("body", 256).alias("sha256"))
    return ingest.url_then_content(p.filter("id % 2 = 1"), p.filter("id % 2 = 0")).select(F.col("id").alias("page_id"), "reused_id")


def merge_raw(spark: SparkSession, d: str) -> DataFrame:
    src = adapter.sources(spark, d).select("doc_id", "id", "sha256")
    next_id = F.concat(F.lit("doc-"), (F.col("doc_id") + 1).cast("string"), F.when(F.col("doc_id") % 10 == 0, "-2").otherwise(""))
    main = src.filter("doc_id % 2 = 0").select(next_id.alias("id"), "sha256").distinct()
    return merge.merge_raw(main, src.filter("doc_id % 2 = 1").select("id", "sha256"))


def snapshot_diff(nodes: DataFrame) -> DataFrame:
    changed = nodes.filter("node_type <> 'Disease'").withColumn("path", F.when(F.col("node_type") == "Gene", F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")))
    return merge.verify_snapshot(merge.snapshot(nodes), changed)


def tree_diff(nodes: DataFrame) -> DataFrame:
    """Genes move, phenotypes get new names, diseases go, procedures change."""
    spark, kind = nodes.sparkSession, F.col("node_type")
    sha = F.sha2(F.concat_ws("|", "node_type", F.coalesce("subtype", F.lit("")), F.coalesce("description", F.lit("")), F.when(F.col("subtype").isNull(), F.col("path")).otherwise("")), 256)
    before = nodes.withColumn("sha256", sha).select("path", "identifier", "sha256", "node_type")
    prefixed = lambda c, kinds: F.coalesce(*(F.when(kind == k, F.concat(F.lit(p), c)) for k, p in kinds.items()), F.col(c)).alias(c)
    after = before.filter(kind != "Disease").select(prefixed("path", {"Gene": "moved/", "Phenotype": "renamed/"}), prefixed("identifier", {"Phenotype": "New "}), prefixed("sha256", {"MethodOrProcedure": "other "}))
    roots = [tables.scratch(spark, name) for name in ("tree-before", "tree-after")]
    for df, root in zip((before, after), roots, strict=True):
        trees.write_tree(df, root)
    return trees.tree_diff(spark, *roots)


def carry_over(nodes: DataFrame) -> DataFrame:
    main = nodes.filter("family = 'clinical'").select("identifier", F.lit("main").alias("base"))
    return merge.carry_over(main, nodes.filter("node_type <> 'Study'").select("identifier", F.lit("other").alias("base")))


def collapse(edges: DataFrame) -> DataFrame:
    matches = edges.sparkSession.createDataFrame([("Part 1", "Part 3"), ("Part 2", "Part 3")], "old string, new string")
    return merge.collapse(edges, matches).groupBy("object", "primary_source").agg(n_rows())


def shortest_paths(edges: DataFrame) -> DataFrame:
    """From a node whose reach takes many hops."""
    found = paths.shortest_paths(edges, edges.sparkSession.createDataFrame([("Order 7",)], "identifier string"))
    return found.select("identifier", "hops", F.array_join("predicates", " > ").alias("predicates"), F.array_join("nodes", " > ").alias("nodes"))


def three_hops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Studies that treat a clinical part, with assertions only, whose supplier is somewhere."""
    hops = [
        paths.Hop(("treats", "not_treats"), ("Disease", "Phenotype", "MethodOrProcedure"), levels=("knowledge_assertion",), sourced=True),
        paths.Hop(("reported_in",), ("Agent",)),
        paths.Hop(("located_in",)),
    ]
    return paths.pattern(edges, hops, nodes, ("Study",))


def similar_names(docs: DataFrame) -> DataFrame:
    """The first two words of documents, those of even against those of odd number."""
    words = F.slice(F.split(matching.name_key(F.col("text")), " "), 1, 2)
    named = docs.select(F.col("doc_id").alias("identifier"), F.array_join(words, " ").alias("name"))
    return matching.similar_names(named.filter("identifier % 2 = 0"), named.filter("identifier % 2 = 1"))


def _merge_map(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The base of all but studies, that of studies and clinical nodes, and how the second merges onto the first: every
    third clinical part is the part itself, and most of these also the third one after it, so that matches chain."""
    main, other = nodes.filter("node_type <> 'Study'"), nodes.filter("family = 'clinical' or node_type = 'Study'")
    k = F.regexp_extract("identifier", "^Part ([0-9]+)$", 1)
    numbered = other.filter(k != "").select(F.col("identifier").alias("old"), k.cast("long").alias("k")).filter("k % 3 = 0")
    new = F.explode(F.when(F.col("k") % 30 <= 21, F.array("k", F.col("k") + 3)).otherwise(F.array("k")))
    return main, other, semantic.merge_map(main, other, numbered.select("old", new.alias("k")).select("old", F.concat(F.lit("Part "), F.col("k").cast("string")).alias("new")))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    out = semantic.merged_nodes(*_merge_map(nodes), ["node_type", "subtype", "note", "description"])
    return out.select("identifier", "node_type", "subtype", "note", "description", F.array_join("also_known", ",").alias("also_known"), F.array_join("origins", ",").alias("origins"), "path")


def merge_conflicts(nodes: DataFrame) -> DataFrame:
    return semantic.scalar_conflicts(*_merge_map(nodes), ["subtype", "description"])


def _split_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    studies = F.startswith(F.col("subject"), F.lit("Order "))
    return edges.filter(~studies), edges.filter(studies)


def _merged_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return semantic.merged_edges(*_split_edges(edges), _merge_map(nodes)[2])


def merge_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _merged_edges(nodes, edges).groupBy("origin", "predicate", "object").agg(n_rows())


def merge_contradictions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of what is said of an object by any subject of its first letter. What is said alike is one row before objects are
    rewritten, and primary sources do not matter."""
    final = _merge_map(nodes)[2]
    main, other = _split_edges(edges.select("subject", "base", "negative", "object"))
    said = semantic.rewritten(main.withColumn("origin", F.lit(semantic.MAIN)).unionByName(other.withColumn("origin", F.lit(semantic.OTHER))), final, ("subject",))
    said = said.select(F.left("subject", F.lit(1)).alias("subject"), "base", "negative", "object", "origin").distinct()
    found = semantic.contradictions(semantic.rewritten(said, final, ("object",)))
    return found.select("subject", "predicate", "object", F.array_join("positive", ",").alias("positive"), F.array_join("negative", ",").alias("negative"))


def knowledge_rank(edges: DataFrame) -> DataFrame:
    ranks = F.array(*map(F.lit, vocab.KNOWLEDGE_LEVELS))
    return edges.groupBy("knowledge_level").agg(n_rows()).withColumn("rank", F.coalesce(F.array_position(ranks, F.col("knowledge_level")), F.lit(0)).cast("long"))


def _lint(spark: SparkSession, d: str) -> DataFrame:
    """Every rule for which the tables hold something."""
    sources = adapter.sources(spark, d)
    return lint.lint(N(spark, d), E(spark, d), sources=sources, raw_files=adapter.raw_files(sources), index=index_lines(spark, d))


def lint_all(spark: SparkSession, d: str) -> DataFrame:
    return _lint(spark, d).groupBy("severity", "rule").agg(n_rows())


def lint_incremental(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Findings after two edits: agents and what they say come to a base without them, and its fifth part of studies goes.
    All three bases are parts of one, which is written once."""
    nodes, edges = tables.materialise(nodes.select(*lint.NODE_COLUMNS), "relint-nodes"), tables.materialise(edges.select(*lint.EDGE_COLUMNS), "relint-edges")
    fifth = lambda c: F.startswith(c, F.lit("Order ")) & F.right(c, F.lit(1)).isin("0", "5") & F.rlike(c, F.lit("^Order [0-9]*[05]$"))
    late, leaving = F.col("node_type") == "Agent", fifth(F.col("identifier"))
    says, left = F.startswith("subject", F.lit("Supplier ")), fifth(F.col("subject"))
    n0, e0 = nodes.filter(~late), edges.filter(~says)
    n1, e1 = nodes, edges
    n2, e2 = nodes.filter(~leaving), edges.filter(~left)
    found = relint.findings(n0, e0)
    found = relint.updated(found, n1, e1, relint.Change(nodes.limit(0), edges.limit(0), nodes.filter(late), edges.filter(says)))
    found = relint.updated(found, n2, e2, relint.Change(nodes.filter(leaving), edges.filter(left), nodes.limit(0), edges.limit(0)), write=False)
    return found.groupBy("severity", "rule").agg(n_rows(), F.min("subject").alias("first_subject"), F.max(F.concat_ws(" ", "subject", "detail")).alias("last_finding"))


def _versions(spark: SparkSession, d: str) -> versions.VersionedTable:
    """The change log in versions: its first half, all of it in two writes, errors left out, and all of it again."""
    h = adapter.history(spark, d).select("commit", "kind", "user_id", "value", "at")
    early = F.col("at") <= F.lit("2024-01-15").cast("timestamp")
    table = versions.VersionedTable(spark, tables.scratch(spark, "versions"))
    table.commit(h.filter(early), "ingest", "first half")
    staged = table.begin()
    staged.append(h.filter(~early & (F.col("kind") == "error")))
    staged.append(h.filter(~early & (F.col("kind") != "error")))
    staged.commit("edit", "second half")
    table.commit(h, "edit", "the same")
    table.commit(h.filter("kind <> 'error'"), "edit", "no errors")
    lost = table.begin()
    lost.append(h.filter(early))
    lost.abort()
    table.restore(2)
    return table


def url_extensions(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, "application/json").when(F.col("page_id") % 3 == 1, "text/plain").otherwise("")
    return df.select("page_id", T.url_extension(F.col("url"), kind, F.left("html", F.lit(256))).alias("ext"))


def publishers(df: DataFrame) -> DataFrame:
    p = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("Springer "), "c_name")).when(F.col("c_custkey") % 4 == 1, "PLOS").otherwise(F.col("c_mktsegment"))
    return df.select("c_custkey", T.allowlisted(p).alias("ok"))


def combined(df: DataFrame) -> DataFrame:
    return ingest.combined(df.select(F.col("conv_id").alias("batch"), F.col("turn").alias("ord"), F.col("role").alias("name"), F.col("text").alias("markdown"), (F.col("role") == "system").alias("needs_llm")), member_cap=None)


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every document against the whole page of its number; null below 50 words, and without a page."""
    pages = adapter.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "html")
    return adapter.table(spark, d, "documents").select("doc_id", "text").join(pages, "doc_id", "left").select("doc_id", T.coverage(F.col("text"), F.col("html")).alias("share"))


def coverage_whole(df: DataFrame) -> DataFrame:
    """Every document against its whole text without markup; null below 50 words."""
    return df.select("doc_id", T.coverage(F.col("text"), T.strip_markup(F.col("text"))).alias("share"))


def _history(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(adapter.history(spark, d))


def _slugs_whole(df: DataFrame) -> DataFrame:
    return df.select("doc_id", T.slug(F.col("text")).alias("slug"))


def _source_ids_whole(df: DataFrame) -> DataFrame:
    return df.select("doc_id", T.source_id(F.col("text"), F.col("text")).alias("source_id"))


def _bm25_index(spark: SparkSession, d: str) -> DataFrame:
    folder = tables.scratch(spark, "search-index")
    search.write_index(_docs(adapter.table(spark, d, "documents")), folder)
    return search.search_index(spark, folder, "the license apache", None)


def _members(df: DataFrame) -> DataFrame:
    name = F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".png").otherwise(".md"))
    return ingest.grouped(df.select(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.col("doc_id").cast("string")).alias("folder"), F.col("doc_id").alias("ord"), name.alias("name"), F.col("n_chars").alias("length"))).select("ord", "role")


def _restored(h: DataFrame) -> DataFrame:
    return history.restore(h, "user_id", "2024-01-15", "back", "2024-12-31").select("user_id", "commit", "kind", "value", "summary")


def _bib_ids(spark: SparkSession, d: str) -> DataFrame:
    pages = adapter.pages(spark, d)
    return credibility.identifiers(pages, F.concat_ws("  ", "url", "body")).select("page_id", "doi", "arxiv", "pmid", "pmcid", "isbn")


def _classified(spark: SparkSession, d: str) -> DataFrame:
    pages = adapter.pages(spark, d).withColumn("filename", F.lit(None).cast("string"))
    return credibility.classify(pages).select("page_id", "source_type", "tier", "confidence")


def _titles(df: DataFrame) -> DataFrame:
    heading = F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("## Heading "), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise(""), "text")
    return df.select("doc_id", T.title_from(heading, F.lit("some_file-name.md"), F.when(F.col("doc_id") % 5 == 0, "given title")).alias("title"))


def _tables(df: DataFrame) -> DataFrame:
    text = F.concat(F.lit('name,"a ""quoted"" | cell", x\n'), F.replace("text", F.lit(" "), F.lit(",")))
    return df.select("doc_id", ingest.table_markdown(text).alias("markdown"))


QUERIES: dict[str, Query] = {
    "scan_first_wins": _nodes(lambda n: normalise.first_wins(n).select("identifier", "file_ord")),
    "type_alias": _nodes(lambda n: n.select("raw_type", "node_type", "type_valid", "is_provenance", "family").distinct()),
    "predicate_alias": _edges(lambda e: e.groupBy("raw_predicate", "predicate", "base", "reversed", "negative", "negated", "pred_valid").agg(n_rows())),
    "get_node": _nodes(lambda n: n.filter("identifier = 'Part 96'").orderBy("file_ord").limit(1).select("identifier", "node_type", "subtype", "path")),
    "subtype_coalesce": _nodes(lambda n: n.select("identifier", normalise.subtype({"subtype": F.col("subtype"), "method": F.col("note"), "kind": F.lit("none")}).alias("subtype"))),
    "kb_id_rule": _table("supplier", kb_ids),
    "resolve_objects": _both(resolve_objects),
    "source_resolution": _both(source_resolution),
    "cited_source_chain": cited,
    "index_substring_anti": index_missing,
    "stats_by_type": _nodes(lambda n: stats.by(n, "node_type")),
    "stats_by_predicate": _edges(lambda e: stats.by(e, "predicate")),
    "stats_totals": _both(stats.totals),
    "catalog_by_type": _nodes(stats.catalog_by_type),
    "members_by_type": _nodes(stats.members_by_type),
    "subtypes_in_use": _nodes(stats.subtypes_in_use),
    "graph_edges": _edges(lambda e: graph.graph_edges(e).groupBy("source", "target", "predicate", "synthesized").agg(n_rows())),
    "graph_nodes": _both(graph.graph_nodes),
    "degree": _edges(graph.degrees),
    "orphans": _both(graph.orphans),
    "adjacency": _edges(lambda e: graph.adjacency(e).groupBy("identifier", "neighbor", "predicate").agg(n_rows())),
    "neighbors": _edges(lambda e: graph.neighbors(e, "Part 7")),
    "node_panel": _edges(lambda e: graph.node_panel(e, "Supplier 3")),
    "two_hop_pattern": _edges(lambda e: graph.two_hop(e, "located_in", "part_of")),
    "reachability": _edges(lambda e: paths.reachable(e, "Customer 5", 4)),
    "reachability_unbounded": _edges(lambda e: paths.reachable(e, "Customer 5")),
    "shortest_paths": _edges(shortest_paths),
    "pattern_three_hops": _both(three_hops),
    "similar_names": _table("documents", similar_names),
    "edge_ordinals": _edges(ordinals),
    "knowledge_rank": _edges(knowledge_rank),
    "tokenize": _table("documents", tokenize),
    "slug": _table("documents", _slugs_whole),
    "sha_id": _table("documents", _source_ids_whole),
    "commit_slug": _table("documents", lambda df: df.select("doc_id", T.commit_slug(F.col("text")).alias("slug"))),
    "kb_id": _table("supplier", lambda df: df.select("s_suppkey", T.kb_id(F.col("s_name")).alias("kb_id"))),
    "slug_whole": _table("documents", _slugs_whole),
    "sha_id_whole": _table("documents", _source_ids_whole),
    "title_from": _table("documents", _titles),
    "csv_table": _table("documents", _tables),
    "bm25_stats": _table("documents", lambda df: search.statistics(_docs(df))),
    "bm25_topk": _table("documents", lambda df: search.bm25(_docs(df), "the license of the", 10)),
    "bm25_scores": _table("documents", lambda df: search.bm25(_docs(df), "the license apache", None)),
    "bm25_index": _bm25_index,
    "search_nodes": _nodes(lambda n: search.search_nodes(n, "building steel 7 brand", 50)),
    "coverage": coverage,
    "coverage_whole": _table("documents", coverage_whole),
    "url_host": lambda spark, d: adapter.pages(spark, d).select("page_id", T.url_host(F.col("url")).alias("host")),
    "bib_ids": _bib_ids,
    "classify_source": _classified,
    "allowlist": _table("customer", publishers),
    "strip_markup": _table("pages", lambda df: df.select("page_id", T.strip_markup(F.col("html")).alias("text"))),
    "url_ext": _table("pages", url_extensions),
    "ingest_dedup": ingest_dedup,
    "url_then_sha_dedup": url_dedup,
    "primary_doc": _table("documents", lambda df: ingest.primary_document(df.select(F.col("source").alias("folder"), F.col("doc_id").alias("ord"), F.col("n_chars").alias("length")))),
    "combined_concat": _table("conversations", combined),
    "folder_groups": _table("documents", _members),
    "merge_raw": merge_raw,
    "snapshot_diff": _nodes(snapshot_diff),
    "tree_diff": _nodes(tree_diff),
    "carry_over": _nodes(carry_over),
    "collapse_references": _edges(collapse),
    "merge_map": _nodes(lambda n: _merge_map(n)[2]),
    "merge_nodes": _nodes(merge_nodes),
    "merge_conflicts": _nodes(merge_conflicts),
    "merge_edges": _both(merge_edges),
    "merge_contradictions": _both(merge_contradictions),
    "log_newest": _history(lambda h: history.newest(h).select("commit", "kind", "summary")),
    "restore_asof": _history(lambda h: history.as_of(h, "user_id", "2024-01-15").select("user_id", "commit", "kind", "value")),
    "restore_forward": _history(_restored),
    "restore_removed": _history(lambda h: _restored(h.withColumn("kind", F.when(F.col("kind") == "error", "remove").otherwise(F.col("kind"))))),
    "change_log_by_day": _history(history.by_day),
    "version_log": lambda spark, d: _versions(spark, d).log().select("version", "parent", "kind", "summary", "added", "removed"),
    "version_restored": lambda spark, d: _versions(spark, d).read().groupBy("kind").agg(n_rows(), F.max("value").alias("largest")),
    "squash": _history(lambda h: history.squash(h, "kind")),
    "graph_json": _both(export.graph_json),
    "index_rows": _nodes(export.index_rows),
    "harmonised_subtypes": _nodes(lambda n: merge.harmonised(n).groupBy("node_type", "subtype").agg(n_rows())),
    "validate": _both(lint.validate),
    "lint_summary": lambda spark, d: lint.verify(_lint(spark, d)),
    "lint_all": lint_all,
    "lint_incremental": _both(lint_incremental),
    "lint_source_not_scholarly": lambda spark, d: lint.source_not_scholarly(N(spark, d), E(spark, d), adapter.sources(spark, d)),
    "lint_source_retracted": lambda spark, d: lint.source_retracted(N(spark, d), E(spark, d), adapter.sources(spark, d)),
    "lint_source_raw_missing_file": lambda spark, d: lint.raw_missing(N(spark, d), adapter.raw_files(adapter.sources(spark, d))),
    **{"lint_" + name.replace(".", "_"): _rule(name) for name in lint.RULES},
}

ORACLE_SQL: dict[str, str] = {**oracle.SQL, **{"lint_" + name.replace(".", "_"): sql for name, sql in oracle.LINT.items()}}
_FOUND = {**oracle.LINT, **oracle.SOURCE_LINT}
ORACLE_SQL["lint_all"] = " UNION ALL ".join(f"SELECT '{lint.SEVERITY[name]}' AS severity, '{name}' AS rule, CAST(count(*) AS BIGINT) AS n FROM ({sql}) HAVING count(*) > 0" for name, sql in _FOUND.items())
_number = lambda s: f"CAST(coalesce(sum(n) FILTER (WHERE severity = '{s}'), 0) AS BIGINT)"
ORACLE_SQL["lint_summary"] = f"SELECT {_number('error')} AS errors, {_number('warn')} AS warnings, {_number('info')} AS infos, {_number('error')} = 0 AS ok FROM ({ORACLE_SQL['lint_all']})"
