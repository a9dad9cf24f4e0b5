"""Conformance rules as queries: each gives (subject, detail); ``lint`` is their union with rule and severity.

Inputs are normalised nodes (with file_ord) and normalised edges. Rules about one row are conditions, tested together
in one pass over nodes and one over edges. What several rules ask of an edge's object or primary source is asked once
for each identifier in use (``reference_findings``), however many edges point to it. A single rule, run by itself, is
the plain query that it stands for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T
from ..sources.tables import materialise
from . import graph, stats

ERROR, WARN, INFO = "error", "warn", "info"
# The rules by severity, in the order in which they are stated.
SEVERITY = {
    **dict.fromkeys(
        [
            "parse", "identifier.duplicate", "type.invalid", "predicate.invalid", "edge.not_negatable", "edge.missing_knowledge_level", "edge.invalid_knowledge_level",
            "edge.missing_agent_type", "edge.invalid_agent_type", "edge.missing_primary_source",
        ],
        ERROR,
    ),
    **dict.fromkeys(
        [
            "identifier.opaque", "source.unanchored", "type.path_mismatch", "edge.duplicate", "value.as_identifier", "other.missing_note", "node.no_reported_in",
            "source.raw_missing_file", "node.orphan", "edge.contradiction", "source.needs_conversion", "source.figure_unnamed", "source.figure_undescribed",
            "source.not_scholarly", "source.retracted", "source.low_coverage", "index.stale", "edge.primary_source_not_provided", "edge.primary_source_unresolved",
            "edge.primary_source_not_source", "edge.object_unresolved", "edge.range", "edge.stat_ci", "edge.stat_pvalue",
        ],
        WARN,
    ),
    **dict.fromkeys(["subtype.missing", "subtype.similar", "predicate.inverse", "edge.missing_direction"], INFO),
}
TEXT = ("subject", "detail")
#: What a source's text holds while it still waits to be rendered; knowledge bases may use another (a parameter).
MARKER = "<!-- needs conversion -->"


def _out(df: DataFrame, subject: str, detail: Column | str) -> DataFrame:
    return df.select(F.col(subject).alias("subject"), (F.col(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"))


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# --- rules about one node or edge: condition, detail -------------------------------------------


def folder_type() -> Column:
    """The node type that the folder of a path is named after."""
    folder = F.when(F.contains("path", F.lit("/")), F.substring_index(F.substring_index("path", "/", -2), "/", 1))
    return vocab.lookup(F.lower(folder), {t.lower(): t for t in vocab.NODE_TYPES})


def node_rows() -> dict[str, tuple[Column, Column]]:
    c = F.col
    return {
        "type.invalid": (~c("type_valid"), c("node_type")),
        "identifier.opaque": (T.curie_like(c("identifier")), c("path")),
        "subtype.missing": (c("subtype").isNull(), c("node_type")),
        "source.unanchored": (F.expr("is_provenance and xref is null and raw_source is null"), c("node_type")),
        "type.path_mismatch": (c("type_valid") & folder_type().isNotNull() & (folder_type() != c("node_type")), folder_type()),
        "value.as_identifier": (T.measurement(c("identifier")), c("path")),
        "other.missing_note": (F.expr("node_type = 'Other' and note is null"), c("path")),
    }


def edge_rows() -> dict[str, tuple[Column, Column]]:
    row = lambda condition, detail: (F.expr(condition), F.col(detail))
    return {
        "predicate.invalid": row("not pred_valid", "predicate"),
        "edge.not_negatable": row("negated_flag and pred_valid and not negative", "predicate"),
        "predicate.inverse": row("reversed", "predicate"),
        "edge.missing_knowledge_level": row("knowledge_level is null", "object"),
        "edge.invalid_knowledge_level": row(f"knowledge_level not in {_in(vocab.KNOWLEDGE_LEVELS)}", "knowledge_level"),
        "edge.missing_agent_type": row("agent_type is null", "object"),
        "edge.invalid_agent_type": row(f"agent_type not in {_in(vocab.AGENT_TYPES)}", "agent_type"),
        "edge.missing_primary_source": row("primary_source is null", "object"),
        "edge.primary_source_not_provided": row("primary_source = 'not_provided'", "object"),
        "edge.missing_direction": row("predicate in ('regulates', 'expressed_in') and direction is null", "predicate"),
        "edge.stat_ci": row("ci_lower > ci_upper", "object"),
        "edge.stat_pvalue": row("p_value < 0 or p_value > 1", "object"),
    }


def row_findings(df: DataFrame, rules: dict[str, tuple[Column, Column]], subject: str) -> DataFrame:
    """severity, rule, subject, detail: all rules about a row in one pass."""
    each = F.array(*(F.when(condition, F.struct(F.lit(SEVERITY[name]).alias("severity"), F.lit(name).alias("rule"), detail.cast("string").alias("detail"))) for name, (condition, detail) in rules.items()))
    found = df.select(F.col(subject).alias("subject"), F.explode(each).alias("f")).filter("f is not null")  # a lambda would not be compiled
    return found.select("f.severity", "f.rule", "subject", "f.detail")


# --- rules that look at several rows ----------------------------------------------------------


def identifier_duplicate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows after the first of an identifier; only identifiers that several rows have, which are written first, are put in
    order."""
    twice = materialise(nodes.groupBy("identifier").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("identifier"), "identifiers-twice")
    return later_rows(nodes.select("identifier", "path", "file_ord").join(twice, "identifier", "left_semi"))


def later_rows(several: DataFrame) -> DataFrame:
    """Of rows (identifier, path, file_ord), those after the first of their identifier."""
    nth = F.row_number().over(Window.partitionBy("identifier").orderBy("file_ord"))
    return _out(several.withColumn("nth", nth).filter("nth > 1"), "identifier", "path")


def no_reported_in(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    hosts = edges.filter("base = 'reported_in'").select(F.col("subject").alias("identifier")).distinct()
    return _out(nodes.filter("not is_provenance").join(hosts, "identifier", "left_anti"), "identifier", "node_type")


def node_orphan(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _out(graph.orphans(nodes, edges), "identifier", "node_type")


def subtype_similar(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _out(stats.similar_subtypes(nodes), "node_type", "spellings")


def edge_duplicate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One finding for each occurrence after the first."""
    again = edges.groupBy("subject", "predicate", "object", F.coalesce("primary_source", F.lit("")).alias("source")).agg((F.count(F.lit(1)) - 1).alias("extra")).filter("extra > 0")
    return _out(again.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("extra")))), "subject", F.concat_ws(" ", "predicate", "object", "source"))


def edge_contradiction(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    both = edges.groupBy("subject", "base", "object").agg(F.bool_or("negative").alias("neg"), F.bool_or(~F.col("negative")).alias("pos")).filter("neg and pos")
    return _out(both, "subject", F.concat_ws(" ", "base", "object"))


def repeated(edges: DataFrame) -> DataFrame:
    """The edges that share subject, base and object with another: no others can be duplicates or contradict each other.
    They are counted by 64-bit hashes, so what is shuffled of an edge is a number; what hashes bring together by chance the
    rules tell apart."""
    hashed = edges.select("subject", "predicate", "base", "negative", "object", "primary_source", F.xxhash64("subject", "base", "object").alias("at"))
    again = materialise(hashed.groupBy("at").agg(F.count(F.lit(1)).alias("edges")).filter("edges > 1").select("at"), "hashes-again")
    return materialise(hashed.join(again, "at", "left_semi").drop("at"), "repeated-edges")


def node_types(nodes: DataFrame) -> DataFrame:
    """identifier, its first row's type and whether that is a provenance type."""
    return nodes.groupBy("identifier").agg(F.min(F.struct("file_ord", "node_type", "is_provenance")).alias("f")).select("identifier", "f.node_type", "f.is_provenance")


def objects_resolved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with object_type, null for an object that no node bears. Types are written first: a hot object can be split."""
    types = materialise(node_types(nodes), "node-types").select(F.col("identifier").alias("object"), F.col("node_type").alias("object_type"), F.lit(True).alias("object_known"))
    return edges.join(types, "object", "left")


def references(edges: DataFrame, roles: tuple[str, ...] = ("object", "source")) -> DataFrame:
    """subject, predicate, base, role (object or source), identifier: what edges point to."""
    named = F.expr("primary_source is not null and primary_source <> 'not_provided'")
    to = {"object": F.struct(F.lit("object").alias("role"), F.col("object").alias("identifier")), "source": F.when(named, F.struct(F.lit("source").alias("role"), F.col("primary_source").alias("identifier")))}
    return edges.select("subject", "predicate", "base", F.explode(F.array(*(to[r] for r in roles))).alias("to")).filter("to is not null").select("subject", "predicate", "base", "to.role", "to.identifier")


#: As what edges use an identifier, in bits; a host is the subject of a reported_in edge. Each base predicate with a range
#: has a further bit, for its objects.
SUBJECT, OBJECT, SOURCE, HOST = 1, 2, 4, 8
RANGED = {base: 16 << i for i, base in enumerate(vocab.RANGES)}


def used_as(*uses: int) -> Column:
    """Whether an identifier is used as any of ``uses``."""
    return F.col("uses").bitwiseAND(F.lit(sum(uses))) != 0


def identifiers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """identifier, rows (nodes that bear it), kind (place of its type in the vocabulary from 1, or 0), is_provenance, uses:
    once for each identifier of nodes, subjects, objects and primary sources.

    All that rules ask of an identifier that one node bears, or none, is numbers in one aggregate, which are combined
    before its only shuffle.
    """
    none = F.lit(0)
    end = lambda column, uses: F.struct(F.col(column).alias("identifier"), uses.alias("uses"))
    host = F.when(F.col("base") == "reported_in", F.lit(SUBJECT | HOST)).otherwise(F.lit(SUBJECT))
    ranged = F.coalesce(vocab.lookup(F.col("base"), RANGED), none).bitwiseOR(F.lit(OBJECT))
    source = F.expr("primary_source is not null and primary_source <> 'not_provided'")
    each = F.array(F.when(F.col("subject").isNotNull(), end("subject", host)), end("object", ranged), F.when(source, end("primary_source", F.lit(SOURCE))))
    ends = edges.select(F.explode(each).alias("e")).filter("e is not null").select("e.identifier", none.alias("rows"), none.alias("kind"), F.lit(False).alias("is_provenance"), "e.uses")
    borne = nodes.filter("identifier is not null").select("identifier", F.lit(1).alias("rows"), kind().alias("kind"), "is_provenance", none.alias("uses"))
    return borne.unionByName(ends).groupBy("identifier").agg(F.sum("rows").alias("rows"), F.max("kind").alias("kind"), F.bool_or("is_provenance").alias("is_provenance"), F.bit_or("uses").alias("uses"))


def kind() -> Column:
    """Place of a node's type in the vocabulary, 0 for one outside it."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, vocab.NODE_TYPES)), F.col("node_type")), F.lit(0)).cast("int")


def by_numbers() -> Column:
    """Whether ``identifiers`` tells all of an identifier: one node bears it, and its type is of the vocabulary."""
    return (F.col("rows") == 1) & (F.col("kind") > 0)


def told(known: DataFrame) -> DataFrame:
    """identifier, node_type, is_provenance, uses of what ``by_numbers`` holds for."""
    return known.filter(by_numbers()).select("identifier", F.element_at(F.array(*map(F.lit, vocab.NODE_TYPES)), F.col("kind")).alias("node_type"), "is_provenance", "uses")


def untold(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """identifier, path, file_ord, node_type, is_provenance, rows, uses: the nodes whose identifier others bear too, or whose
    type is outside the vocabulary; ``identifiers`` does not tell all of those."""
    of = nodes.select("identifier", "path", "file_ord", "node_type", "is_provenance", kind().alias("kind"))
    twice = materialise(known.filter("rows > 1").select("identifier", "rows", "uses"), "identifiers-twice")
    once = known.filter("rows = 1 and kind = 0").select("identifier", "rows", "uses")
    both = of.join(twice, "identifier").unionByName(of.filter("kind = 0").join(once, "identifier"))
    return materialise(both.drop("kind"), "untold-nodes")


def nodes_in_use(known: DataFrame, rest: DataFrame) -> DataFrame:
    """identifier, node_type, is_provenance, uses, last (in file order of its identifier) of every node that bears an
    identifier; rest: the ``untold`` ones."""
    last = rest.filter("rows > 1").groupBy("identifier").agg(F.max("file_ord").alias("last_ord"))
    others = rest.join(last, "identifier", "left").select("identifier", "node_type", "is_provenance", "uses", F.coalesce(F.col("file_ord") == F.col("last_ord"), F.col("rows") == 1).alias("last"))
    return told(known).withColumn("last", F.lit(True)).unionByName(others)


def orphan_nodes(used: DataFrame) -> DataFrame:
    """Findings of node.orphan, of ``nodes_in_use``."""
    return _out(used.filter(~(used_as(SUBJECT, OBJECT, SOURCE) & F.col("last"))), "identifier", "node_type")


def nodes_not_reported(used: DataFrame) -> DataFrame:
    """Findings of node.no_reported_in, of ``nodes_in_use``."""
    return _out(used.filter(~F.col("is_provenance") & ~used_as(HOST)), "identifier", "node_type")


def targets(known: DataFrame, rest: DataFrame) -> DataFrame:
    """identifier, named, node_type, is_provenance, object, source, uses of every object and primary source, as
    ``reference_findings`` asks of them: the type is that of its first node; rest: the ``untold`` ones."""
    first = node_types(rest).join(known.filter(~by_numbers() & (F.col("rows") > 0)).select("identifier", "uses"), "identifier")
    nobody = known.filter("rows = 0").select("identifier", F.lit(None).cast("string").alias("named"), F.lit(None).cast("string").alias("node_type"), F.lit(None).cast("boolean").alias("is_provenance"), "uses")
    borne = told(known).unionByName(first).withColumn("named", F.col("identifier"))
    return borne.unionByName(nobody).filter(used_as(OBJECT, SOURCE)).withColumns({"object": used_as(OBJECT), "source": used_as(SOURCE)})


def reference_rows() -> dict[str, Column]:
    """Rules about an identifier in use (role, named, node_type, is_provenance; the last three null where no node bears it)."""
    known, source, obj = F.col("named").isNotNull(), F.col("role") == "source", F.col("role") == "object"
    return {
        "edge.primary_source_unresolved": source & ~known,
        "edge.primary_source_not_source": source & known & ~F.col("is_provenance"),
        "edge.object_unresolved": obj & ~known,
    }


def reference_findings(nodes: DataFrame, each: DataFrame, names: list[str] | None = None) -> DataFrame:
    """severity, rule, subject, identifier, detail of rules over ``references``.

    Types are looked up once for each identifier in use, however many edges point to it; edges meet only what is at fault,
    which is written first.
    """
    names = REFERENCE_RULES if names is None else names
    in_range = F.when(F.col("role") == "object", F.coalesce(vocab.lookup(F.col("base"), RANGED), F.lit(0))).otherwise(F.lit(0))
    used = (each.filter(in_range > 0) if names == ["edge.range"] else each).groupBy("identifier").agg(*(F.bool_or(F.col("role") == r).alias(r) for r in ("object", "source")), F.bit_or(in_range).alias("uses"))
    used = materialise(used, "identifiers-in-use")
    borne = nodes.select("identifier", "file_ord", "node_type", "is_provenance").join(used.select("identifier"), "identifier", "left_semi")
    types = materialise(node_types(borne), "node-types").withColumnsRenamed({"identifier": "named"})
    return at_fault(each, *faults(used.join(types, used.identifier == types.named, "left"), names), names)


def faults(of: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What is at fault of identifiers in use (identifier, named, node_type, is_provenance, object, source, uses), written:
    _at, role, severity, rule; and _base, _at, node_type of what is outside a range."""
    names = REFERENCE_RULES if names is None else names
    label = lambda name: F.struct(F.lit(SEVERITY[name]).alias("severity"), F.lit(name).alias("rule"))
    role = F.explode(F.array_compact(F.array(*(F.when(F.col(r), F.lit(r)) for r in ("object", "source"))))).alias("role")
    fault = F.coalesce(*(F.when(condition & F.lit(name in names), label(name)) for name, condition in reference_rows().items()))
    roles = of.select("identifier", "named", "is_provenance", role).withColumn("fault", fault).filter("fault is not null")
    base = F.explode(F.array_compact(F.array(*(F.when(used_as(bit) & ~F.col("node_type").isin(vocab.RANGES[base]), F.lit(base)) for base, bit in RANGED.items())))).alias("_base")
    outside = of.filter(F.col("named").isNotNull() & F.lit("edge.range" in names)).select(base, F.col("identifier").alias("_at"), "node_type")
    return materialise(roles.select(F.col("identifier").alias("_at"), "role", "fault.severity", "fault.rule"), "faulty-references"), materialise(outside, "outside-ranges")


def at_fault(each: DataFrame, roles: DataFrame, outside: DataFrame, names: list[str] | None = None) -> DataFrame:
    """severity, rule, subject, identifier, detail of ``references`` to what is at fault (``faults``)."""
    names = REFERENCE_RULES if names is None else names
    parts = []
    if names != ["edge.range"]:
        for r in ("object", "source"):  # apart, so that none of them is larger than it must be
            at = roles.filter(F.col("role") == r).drop("role")
            parts.append(each.filter(F.col("role") == r).select("subject", "identifier").join(at, F.col("identifier").eqNullSafe(F.col("_at"))).select("severity", "rule", "subject", "identifier", F.col("identifier").alias("detail")))
    if "edge.range" in names:
        found = each.filter(F.col("role") == "object").join(outside, (F.col("base") == F.col("_base")) & (F.col("identifier") == F.col("_at")))
        parts.append(found.select(F.lit(SEVERITY["edge.range"]).alias("severity"), F.lit("edge.range").alias("rule"), "subject", "identifier", F.concat_ws(" ", "predicate", "identifier", "node_type").alias("detail")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


Rule = Callable[[DataFrame, DataFrame], DataFrame]


def _of_nodes(name: str) -> Rule:
    return lambda nodes, edges: _only(nodes, node_rows()[name], "identifier")


def _of_edges(name: str) -> Rule:
    return lambda nodes, edges: _only(edges, edge_rows()[name], "subject")


def _of_references(name: str) -> Rule:
    """By itself, a rule makes references of its own kind only."""
    roles = ("object",) if name in ("edge.object_unresolved", "edge.range") else ("source",)
    return lambda nodes, edges: reference_findings(nodes, references(edges, roles), [name]).select("subject", "detail")


def _only(df: DataFrame, rule: tuple[Column, Column], subject: str) -> DataFrame:
    return df.filter(rule[0]).select(F.col(subject).alias("subject"), rule[1].cast("string").alias("detail"))


NODE_RULES = ["type.invalid", "identifier.opaque", "subtype.missing", "source.unanchored", "type.path_mismatch", "value.as_identifier", "other.missing_note"]
EDGE_RULES = [
    "predicate.invalid", "edge.not_negatable", "predicate.inverse", "edge.missing_knowledge_level", "edge.invalid_knowledge_level", "edge.missing_agent_type",
    "edge.invalid_agent_type", "edge.missing_primary_source", "edge.primary_source_not_provided", "edge.missing_direction", "edge.stat_ci", "edge.stat_pvalue",
]
REFERENCE_RULES = ["edge.primary_source_unresolved", "edge.primary_source_not_source", "edge.object_unresolved", "edge.range"]
#: Rules that look at several rows.
SET_RULES: dict[str, Rule] = {
    "identifier.duplicate": identifier_duplicate,
    "edge.duplicate": edge_duplicate,
    "node.no_reported_in": no_reported_in,
    "node.orphan": node_orphan,
    "edge.contradiction": edge_contradiction,
    "subtype.similar": subtype_similar,
}
#: Every rule over nodes and edges, as a query of its own.
RULES: dict[str, Rule] = {
    **{name: _of_nodes(name) for name in NODE_RULES},
    **SET_RULES,
    **{name: _of_edges(name) for name in EDGE_RULES},
    **{name: _of_references(name) for name in REFERENCE_RULES},
}


def rule(name: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return RULES[name](nodes, edges)


NODE_COLUMNS = ["identifier", "node_type", "type_valid", "is_provenance", "subtype", "note", "xref", "raw_source", "raw_sources", "path", "file_ord"]
EDGE_COLUMNS = ["subject", "predicate", "pred_valid", "base", "reversed", "negative", "negated_flag", "object", "knowledge_level", "agent_type", "primary_source", "direction", "ci_lower", "ci_upper", "p_value"]


def lint(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, raw_files: DataFrame | None = None, parse_errors: DataFrame | None = None, index: DataFrame | None = None, marker: str = MARKER) -> DataFrame:
    """severity, rule, subject, detail of every finding of every rule whose input is given.

    sources: id, tier, retracted, classified, and body, figures, text_layer where the rules about those are wanted;
    raw_files: path of every raw file and folder; parse_errors: path, error; index: line of the index.
    Nodes and edges are written once, with the columns that rules need.
    """
    nodes = materialise(nodes.select(*(c for c in NODE_COLUMNS if c in nodes.columns)), "lint-nodes")
    edges = materialise(edges.select(*EDGE_COLUMNS), "lint-edges")
    named = lambda name, df: df.select(F.lit(SEVERITY[name]).alias("severity"), F.lit(name).alias("rule"), *TEXT)
    parts = [row_findings(nodes, node_rows(), "identifier"), row_findings(edges, edge_rows(), "subject"), reference_findings(nodes, references(edges)).drop("identifier")]
    parts += [named(name, f(nodes, edges)) for name, f in SET_RULES.items()]
    if parse_errors is not None:
        parts.append(named("parse", parse_findings(parse_errors)))
    if raw_files is not None:
        parts.append(named("source.raw_missing_file", raw_missing(nodes, raw_files)))
    if sources is not None:
        cited = cited_sources(nodes, edges, sources)
        parts += [named("source.not_scholarly", _not_scholarly(cited)), named("source.retracted", _retracted(cited))]
        if "body" in sources.columns:
            parts.append(named("source.needs_conversion", needs_conversion(sources, marker)))
            if "figures" in sources.columns:
                parts += [named("source.figure_unnamed", figures_unnamed(sources)), named("source.figure_undescribed", figures_undescribed(sources))]
            if "text_layer" in sources.columns:
                parts.append(named("source.low_coverage", low_coverage(sources, marker)))
    if index is not None:
        parts.append(named("index.stale", _out(stats.index_missing(nodes, index), "identifier", F.lit(None))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def verify(findings: DataFrame) -> DataFrame:
    """One row: errors, warnings, infos, ok."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return findings.agg(n(ERROR).alias("errors"), n(WARN).alias("warnings"), n(INFO).alias("infos"), (n(ERROR) == 0).alias("ok"))


def validate(nodes: DataFrame, edges: DataFrame, parse_errors: DataFrame | None = None) -> DataFrame:
    """path, identifier, edge_count, hard, soft, valid: every document by itself, without the other documents.

    Hard are what makes it invalid: no parse, a type, predicate or enumeration outside the vocabulary, a missing part of
    the provenance. Soft: an identifier like a CURIE (brackets do not save it here), no subtype, an unanchored source, a
    missing direction. Edges belong to documents by path, where they have one, else by their subject.
    """
    key = "path" if "path" in edges.columns else "identifier"
    count = lambda *conditions: sum((F.coalesce(c.cast("long"), F.lit(0).cast("long")) for c in conditions), F.lit(0).cast("long"))
    rows, own = edge_rows(), node_rows()
    hard = ["predicate.invalid", "edge.missing_knowledge_level", "edge.invalid_knowledge_level", "edge.missing_agent_type", "edge.invalid_agent_type", "edge.missing_primary_source"]
    of = edges.withColumn("_key", F.col("path" if key == "path" else "subject"))
    per = of.groupBy("_key").agg(F.count(F.lit(1)).alias("edge_count"), F.sum(count(*(rows[r][0] for r in hard))).alias("edge_hard"), F.sum(count(rows["edge.missing_direction"][0])).alias("edge_soft"))
    curie = F.col("identifier").contains(":") & ~F.col("identifier").contains(" ")
    judged = nodes.select("path", "identifier", F.col(key).alias("_of"), count(own["type.invalid"][0]).alias("own_hard"), count(curie, own["subtype.missing"][0], own["source.unanchored"][0]).alias("own_soft"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = judged.join(per, judged._of == per._key, "left").select("path", "identifier", zero("edge_count").alias("edge_count"), (F.col("own_hard") + zero("edge_hard")).alias("hard"), (F.col("own_soft") + zero("edge_soft")).alias("soft"))
    if parse_errors is not None:
        none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        out = out.unionByName(parse_errors.select("path", F.lit("").alias("identifier"), none.alias("edge_count"), one.alias("hard"), none.alias("soft")))
    return out.withColumn("valid", F.col("hard") == 0)


# --- rules over ingested sources --------------------------------------------------------------


def raw_paths(nodes: DataFrame) -> DataFrame:
    """identifier, ord, path of every raw path that a node names (raw_sources, or the one in raw_source)."""
    every = F.col("raw_sources") if "raw_sources" in nodes.columns else F.array_compact(F.array("raw_source"))
    return nodes.select("identifier", F.posexplode(every).alias("ord", "path"), *(["file_ord"] if "file_ord" in nodes.columns else []))


def raw_folder(path: Column) -> Column:
    """The folder of a raw path: the path itself where its last part has no extension."""
    return F.rtrim(F.when(path.rlike(r"(?:^|/)[^/]+\.[^/.]*$"), F.regexp_replace(path, "/?[^/]*$", "")).otherwise(path), F.lit("/"))


def cited_sources(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """primary_source, tier, retracted of every primary source in use that has been classified.

    A source is what the first node of that identifier says; of its raw paths in turn, the first whose folder has
    metadata counts.
    """
    named = edges.filter("primary_source is not null and primary_source <> 'not_provided'").select(F.col("primary_source").alias("identifier")).distinct()
    first = nodes.groupBy("identifier").agg(F.min("file_ord").alias("file_ord"))
    anchored = raw_paths(nodes.join(first, ["identifier", "file_ord"], "left_semi")).join(named, "identifier", "left_semi")
    known = anchored.withColumn("folder", raw_folder(F.col("path"))).join(sources.select(F.concat(F.lit("raw/"), "id").alias("folder"), "tier", "retracted", "classified"), "folder")
    meta = known.groupBy("identifier").agg(F.min_by(F.struct("tier", "retracted", "classified"), "ord").alias("m"))
    return meta.filter("m.classified").select(F.col("identifier").alias("primary_source"), "m.tier", "m.retracted")


def _not_scholarly(cited: DataFrame) -> DataFrame:
    return _out(cited.filter("tier in ('web', 'unknown')"), "primary_source", "tier")


def _retracted(cited: DataFrame) -> DataFrame:
    return _out(cited.filter("retracted"), "primary_source", "tier")


def source_not_scholarly(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    return _not_scholarly(cited_sources(nodes, edges, sources))


def source_retracted(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    return _retracted(cited_sources(nodes, edges, sources))


def raw_missing(nodes: DataFrame, raw_files: DataFrame) -> DataFrame:
    """Raw paths of nodes at which nothing lies; raw_files: path of every raw file and folder."""
    named = raw_paths(nodes).withColumn("at", F.rtrim("path", F.lit("/")))
    return _out(named.join(raw_files.select(F.col("path").alias("at")).distinct(), "at", "left_anti"), "identifier", "path")


def needs_conversion(sources: DataFrame, marker: str = MARKER) -> DataFrame:
    return _out(sources.filter(F.col("body").contains(marker)), "id", F.concat(F.lit("raw/"), F.col("id"), F.lit("/source.md")))


def _figures(sources: DataFrame) -> DataFrame:
    return sources.select("id", F.coalesce("body", F.lit("")).alias("body"), F.explode("figures").alias("f"))


def figures_unnamed(sources: DataFrame) -> DataFrame:
    """Figures that still have a provisional name; sources: id, body, figures array<struct<file, provisional>>."""
    return _out(_figures(sources).filter("f.provisional"), "id", "f.file")


def figures_undescribed(sources: DataFrame) -> DataFrame:
    """Figures without a description in brackets before a reference to them."""
    quoted = F.concat(F.lit(r"\Q"), F.col("f.file"), F.lit(r"\E"))
    described = F.regexp_like("body", F.concat(F.lit(r"\[[^\[]*[^\s\[][^\[]*\]\("), quoted, F.lit(r"\)")))
    return _out(_figures(sources).filter(~described), "id", "f.file")


def low_coverage(sources: DataFrame, marker: str = MARKER, least: float = 0.6) -> DataFrame:
    """Rendered sources whose extracted text (text_layer) is found in the rendering to less than ``least``."""
    rendered = sources.filter(F.col("text_layer").isNotNull() & ~F.col("body").contains(marker))
    return _out(rendered.withColumn("share", T.coverage(F.col("text_layer"), F.col("body"))).filter(F.col("share") < least), "id", "share")


def parse_findings(parse_errors: DataFrame) -> DataFrame:
    return parse_errors.select(F.col("path").alias("subject"), F.col("error").alias("detail"))
