"""Lint kept up to date: after a change only what it can have touched is judged anew.

Every finding tells what it hangs on: the identifier of the row it is about, the identifier
that an edge points to, the end of an edge (for orphans), or a spelling of a subtype.
A change of documents, given as the rows removed and added, gives the keys that it touches.
Findings on those keys go, and the rules run again over the rows with those keys only, which are
filtered by semi-joins before anything is aggregated. The result is what a full lint would give.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..sources.tables import materialise
from . import lint, stats

OUT = ["severity", "rule", "subject", "detail"]
#: What is stored of a finding. ``of`` is what it hangs on besides its subject: the identifier that an edge points to, or
#: the folded form of a subtype. Its severity follows from its rule.
STORED = ["rule", "subject", "detail", "of"]


@dataclass(frozen=True)
class Change:
    """Normalised nodes and edges that went and that came; what is in both has not changed."""

    removed_nodes: DataFrame
    removed_edges: DataFrame
    added_nodes: DataFrame
    added_edges: DataFrame


def _stored(rule: str | Column, findings: DataFrame, of: str | Column | None = None) -> DataFrame:
    of = F.lit(None).cast("string") if of is None else of
    return findings.select((F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), "subject", "detail", (F.col(of) if isinstance(of, str) else of).alias("of"))


def _shown(stored: DataFrame) -> DataFrame:
    """Severity, which is not stored, and what is."""
    return stored.select(vocab.lookup(F.col("rule"), lint.SEVERITY).alias("severity"), *STORED)


def _spelling(node_type: str = "node_type", folded: str | Column | None = None) -> Column:
    """The key of a node's subtype, whatever its spelling; none without one."""
    folded = F.lower(F.regexp_replace("subtype", "[^A-Za-z0-9]", "")) if folded is None else folded
    return F.concat(F.col(node_type), F.lit(" "), folded)


def _among(df: DataFrame, column: str, ids: DataFrame | None, how: str = "left_semi") -> DataFrame:
    return df if ids is None else df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, how)


def _judged(nodes: DataFrame, edges: DataFrame, own: DataFrame | None, ends: DataFrame | None, spellings: DataFrame | None) -> DataFrame:
    """STORED of all rules over nodes and edges, for the identifiers ``own``, ``ends`` (own among them) and the keys
    ``spellings`` (None: for all).

    What several rules ask of identifiers is one table of numbers. By way of it, and written, are found the nodes and edges
    in question, so that where they are few no others are shuffled.
    """
    known = materialise(lint.identifiers(nodes, edges), "identifiers")
    rest = lint.untold(nodes, known)
    asked = my_nodes = my_edges = None
    if own is None:
        asked, my_nodes, my_edges = known, nodes, edges
    else:
        asked = materialise(_among(known, "identifier", ends), "asked-identifiers")
        mine = materialise(_among(asked, "identifier", own), "touched-identifiers")
        my_nodes = materialise(_among(nodes, "identifier", materialise(mine.filter("rows > 0").select("identifier"), "touched-bearers")), "touched-nodes")
        my_edges = materialise(_among(edges, "subject", materialise(mine.filter(lint.used_as(lint.SUBJECT)).select("identifier"), "touched-subjects")), "touched-edges")
    used = lint.nodes_in_use(asked, _among(rest, "identifier", ends))
    again = lint.repeated(my_edges)
    parts = [
        _stored(F.col("rule"), lint.row_findings(my_nodes, lint.node_rows(), "identifier")),
        _stored(F.col("rule"), lint.row_findings(my_edges, lint.edge_rows(), "subject")),
        _stored("identifier.duplicate", lint.later_rows(_among(rest.filter("rows > 1"), "identifier", own))),
        _stored("edge.duplicate", lint.edge_duplicate(my_nodes, again)),
        _stored("edge.contradiction", lint.edge_contradiction(my_nodes, again)),
        _stored("node.no_reported_in", lint.nodes_not_reported(_among(used, "identifier", own))),
        _stored("node.orphan", lint.orphan_nodes(used)),
    ]
    targets = lint.targets(known, rest)
    roles, outside = lint.faults(targets)
    found = [lint.at_fault(lint.references(my_edges), roles, outside)]
    if own is None:
        parts.append(_stored("node.no_reported_in", lint.no_reported_in(nodes.filter("identifier is null"), edges.limit(0))))
    else:
        # Edges of other subjects, to what is touched. These findings are written before those subjects are told apart, else
        # the optimiser would do that first, for all edges.
        touched = [materialise(_among(faulty, "_at", own), "touched-faults") for faulty in (roles, outside)]
        found.append(_among(materialise(lint.at_fault(lint.references(edges), *touched), "touched-references"), "subject", own, "left_anti"))
    parts += [_stored(F.col("rule"), f, "identifier") for f in found]
    spelt = stats.subtypes_in_use(nodes)
    if spellings is not None:
        spelt = _among(spelt.withColumn("_spelling", _spelling()), "_spelling", spellings)
    parts.append(_stored("subtype.similar", stats.similar_subtypes(spelt).select(F.col("node_type").alias("subject"), F.col("spellings").alias("detail"), "folded"), "folded"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """severity, rule, subject, detail, of: every finding over normalised nodes and edges, written."""
    return _shown(materialise(_judged(*_slim(nodes, edges), None, None, None), "findings"))


def _slim(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes.select(*(c for c in lint.NODE_COLUMNS if c in nodes.columns)), edges.select(*lint.EDGE_COLUMNS)


def updated(before: DataFrame, nodes: DataFrame, edges: DataFrame, change: Change, write: bool = True) -> DataFrame:
    """``findings`` of ``nodes`` and ``edges`` as they are after ``change``, from those ``before`` it. Where they are read
    only once, as after a last edit, they need not be written."""
    nodes, edges = _slim(nodes, edges)
    each = lambda df, *columns: df.select(F.explode(F.array(*columns)).alias("id")).filter("id is not null")
    gone_or_new = change.removed_nodes.select("identifier", "node_type", "subtype").unionByName(change.added_nodes.select("identifier", "node_type", "subtype"))
    moved = change.removed_edges.select("subject", "object", "primary_source").unionByName(change.added_edges.select("subject", "object", "primary_source"))
    own = materialise(each(gone_or_new, "identifier").unionByName(each(moved, "subject")).distinct(), "touched")
    ends = materialise(own.unionByName(each(moved, "object", "primary_source")).distinct(), "touched-ends")
    spellings = materialise(stats.subtypes_in_use(gone_or_new).select(_spelling().alias("key")).filter("key is not null").distinct(), "touched-spellings")
    # Of each kind of findings apart: what no reference is about has nothing in ``of``, and few hang on ends or spellings.
    orphan, similar = F.col("rule") == "node.orphan", F.col("rule") == "subtype.similar"
    mine, others = before.filter(~orphan & ~similar & F.col("of").isNull()), before.filter(~similar & F.col("of").isNotNull())
    targets = materialise(_among(others.select("of").distinct(), "of", own), "touched-targets")
    spelt = before.filter(similar).withColumn("_spelling", _spelling("subject", F.col("of")))
    kept = [_among(mine, "subject", own, "left_anti"), _among(_among(others, "of", targets, "left_anti"), "subject", own, "left_anti"), _among(before.filter(orphan), "subject", ends, "left_anti"), _among(spelt, "_spelling", spellings, "left_anti")]
    out = _judged(nodes, edges, own, ends, spellings)
    for part in kept:
        out = out.unionByName(part.select(*STORED))
    return _shown(materialise(out, "findings") if write else out)
