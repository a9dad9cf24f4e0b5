"""Paths: distances without a bound on hops, shortest paths with their predicates, and typed patterns of several hops.

Distances spread from the starts in rounds, each of them one equi-join of what improved in the
last round with the links, whose hubs adaptive execution splits as both sides are written.
Chains (nodes with one way in and one way out) are drawn together beforehand by pointer
doubling, so that rounds follow how often a graph branches along its paths, not their length.
Paths are read off the distances afterwards: each node has one parent, and lists of predicates
are joined by doubling as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..sources.tables import materialise
from . import graph


def _jumps(pointers: DataFrame, inner: DataFrame) -> DataFrame:
    """node, end, n: where ``pointers`` (node, end; one for each row of ``inner``, a table of node) lead from inner nodes,
    past all other inner ones, and in how many steps. Inner nodes on a ring of their own lead nowhere."""
    inside = inner.select(F.col("node").alias("end"), F.lit(True).alias("inside"))
    mark = lambda df: df.join(inside, "end", "left").withColumn("inside", F.col("inside").isNotNull())
    now = materialise(mark(pointers.withColumn("n", F.lit(1).cast("long"))), "jumps")
    left = now.filter("inside").count()
    while left:
        onward = now.select(F.col("node").alias("end"), F.col("end").alias("far"), F.col("n").alias("more"), F.col("inside").alias("still"))
        moved = now.filter("inside").join(onward, "end").select("node", F.col("far").alias("end"), (F.col("n") + F.col("more")).alias("n"), F.col("still").alias("inside"))
        now = materialise(now.filter("not inside").unionByName(moved), "jumps")
        before, left = left, now.filter("inside").count()
        if before == left:  # a step halves every chain that ends, so what is left is rings
            return now.filter("not inside").drop("inside")
    return now.drop("inside")


def _spread(links: DataFrame, starts: DataFrame, max_hops: int | None) -> DataFrame:
    """identifier, hops: the least sum of n along ``links`` (source, target, n) from ``starts``."""
    seen = front = materialise(starts.select("identifier", F.lit(0).cast("long").alias("hops")).distinct(), "seen")
    while not front.isEmpty():
        step = links.join(front, links.source == front.identifier).groupBy("target").agg(F.min(F.col("hops") + F.col("n")).alias("reached"))
        if max_hops is not None:
            step = step.filter(F.col("reached") <= max_hops)
        better = F.col("identifier").isNull() | (F.col("reached") < F.col("hops"))
        both = seen.join(step, seen.identifier == step.target, "full").select(F.coalesce("identifier", "target").alias("identifier"), F.least("hops", "reached").alias("hops"), F.coalesce(better & F.col("target").isNotNull(), F.lit(False)).alias("better"))
        now = materialise(both, "seen")
        seen, front = now.drop("better"), now.filter("better").drop("better")
    return seen


def distances(links: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """identifier, hops of all that ``starts`` (identifier) reach along ``links`` (source, target), itself included.

    Null ends and loops do not count, repeated links count once. Without ``max_hops`` there is no bound.
    """
    once = materialise(links.select("source", "target").filter("source <> target").distinct(), "links")
    if max_hops is not None:
        return _spread(once.withColumn("n", F.lit(1).cast("long")), starts, max_hops)
    one_in = once.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("before")).filter("n = 1").select(F.col("target").alias("node"), "before")
    one_out = once.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("after")).filter("n = 1").select(F.col("source").alias("node"), "after")
    inner = materialise(one_in.join(one_out, "node").join(starts.select(F.col("identifier").alias("node")), "node", "left_anti"), "inner")
    if inner.isEmpty():
        return _spread(once.withColumn("n", F.lit(1).cast("long")), starts, None)
    ahead = _jumps(inner.select("node", F.col("after").alias("end")), inner)
    outer = once.join(inner.select(F.col("node").alias("source")), "source", "left_anti")
    past = outer.join(ahead.select(F.col("node").alias("target"), F.col("end"), F.col("n").alias("more")), "target", "left")
    short = past.groupBy("source", F.coalesce("end", "target").alias("target")).agg(F.min(F.coalesce("more", F.lit(0)) + 1).alias("n"))
    far = _spread(materialise(short.filter("source <> target"), "short-links"), starts, None)
    behind = _jumps(inner.select("node", F.col("before").alias("end")), inner)
    within = behind.join(far, behind.end == far.identifier).select(F.col("node").alias("identifier"), (F.col("hops") + F.col("n")).alias("hops"))
    # A chain that ends nowhere has no outer end: its nodes are reached from behind all the same.
    return materialise(far.unionByName(within).groupBy("identifier").agg(F.min("hops").alias("hops")), "distances")


def reachable(edges: DataFrame, start: str, max_hops: int | None = None) -> DataFrame:
    """identifier, hops: what one node reaches along authored edges."""
    found = distances(graph.oriented(edges), edges.sparkSession.createDataFrame([(start,)], "identifier string"), max_hops)
    return found.withColumn("hops", F.col("hops").cast("int"))


def parents(steps: DataFrame, found: DataFrame) -> DataFrame:
    """identifier, hops, parent, predicate: the first step (by parent, then predicate) of ``steps`` (source, target,
    predicate) that leads to each node of ``found`` on a shortest path; none for the starts."""
    at = found.select(F.col("identifier").alias("source"), F.col("hops").alias("from_hops"))
    to = found.select(F.col("identifier").alias("target"), "hops")
    near = steps.select("source", "target", "predicate").join(at, "source").join(to, "target").filter(F.col("hops") == F.col("from_hops") + 1)
    best = near.groupBy("target", "hops").agg(F.min(F.struct("source", "predicate")).alias("best"))
    return best.select(F.col("target").alias("identifier"), "hops", F.col("best.source").alias("parent"), F.col("best.predicate").alias("predicate"))


def shortest_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """identifier, hops, start, predicates (in turn, from the start), nodes (from the start to the identifier) of one
    shortest path along authored edges to each node that ``starts`` (identifier) reach, or to ``targets`` only."""
    steps = graph.oriented(edges).filter("source <> target").groupBy("source", "target").agg(F.min(F.struct("predicate"))["predicate"].alias("predicate"))
    steps = materialise(steps, "steps")  # of links with the same ends the first predicate counts
    found = materialise(distances(steps, starts, max_hops), "distances")
    tree = materialise(parents(steps, found), "parents")
    if targets is not None:
        tree = materialise(_ancestry(tree, targets), "parents")
    # A round doubles the paths that have not come to a start yet; whole ones are written once, and only read from then on.
    whole_one = F.size("predicates") == F.col("hops")
    now = tree.select("identifier", "hops", F.col("parent").alias("top"), F.array("predicate").alias("predicates"), F.array("parent").alias("nodes"))
    done, left = now.filter(whole_one), now.filter(~whole_one)
    while not left.isEmpty():
        above = done.unionByName(left).select(F.col("identifier").alias("top"), F.col("top").alias("far"), F.col("predicates").alias("before"), F.col("nodes").alias("earlier"))
        step = left.join(above, "top").select("identifier", "hops", F.col("far").alias("top"), F.concat("before", "predicates").alias("predicates"), F.concat("earlier", "nodes").alias("nodes"))
        step = materialise(step, "paths")
        done, left = done.unionByName(step.filter(whole_one)), step.filter(~whole_one)
    now = done
    whole = now.select("identifier", "hops", F.col("top").alias("start"), "predicates", F.concat("nodes", F.array("identifier")).alias("nodes"))
    none = F.array().cast("array<string>")
    begun = found.filter("hops = 0").select("identifier", "hops", F.col("identifier").alias("start"), none.alias("predicates"), F.array("identifier").alias("nodes"))
    out = whole.unionByName(begun)
    return out if targets is None else out.join(targets.select("identifier").distinct(), "identifier", "left_semi")


def _ancestry(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of ``tree`` that are above ``targets`` or are them: each node learns by doubling whether a target is below."""
    marked = materialise(targets.select("identifier").distinct(), "marked")
    hop = materialise(tree.select("identifier", F.col("parent").alias("up")), "up")
    while True:
        more = marked.join(hop, "identifier").select(F.col("up").alias("identifier"))
        now = materialise(marked.union(more).distinct(), "marked")
        far = hop.join(hop.select(F.col("identifier").alias("up"), F.col("up").alias("far")), "up").select("identifier", F.col("far").alias("up"))
        marked, hop = now, materialise(far, "up")
        if hop.isEmpty():
            return tree.join(marked, "identifier", "left_semi")


# --- patterns ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Hop:
    """One step of a pattern along graph edges: any of ``predicates``, to a node of one of ``types``, with provenance."""

    predicates: tuple[str, ...]
    types: tuple[str, ...] = ()  # any
    backward: bool = False  # from the edge's target to its source
    either: bool = False  # both ways
    levels: tuple[str, ...] = ()  # knowledge levels that count; any
    agents: tuple[str, ...] = ()  # agent types that count; any
    sourced: bool = False  # only with a primary source that is provided


def _kept(hop: Hop) -> Column:
    keep = F.col("predicate").isin(*hop.predicates)
    for names, column in ((hop.levels, "knowledge_level"), (hop.agents, "agent_type")):
        if names:
            keep = keep & F.col(column).isin(*names)
    return keep & F.expr("primary_source is not null and primary_source <> 'not_provided'") if hop.sourced else keep


def _pairs(edges: DataFrame, hop: Hop, nodes: DataFrame | None) -> DataFrame:
    """start, finish, n_paths, rank of one hop; what agrees in both ends is counted before the shuffle."""
    ends = [("object", "subject"), ("subject", "object")]
    one = lambda flip: F.struct(*(F.when(F.col("reversed") != F.lit(flip), F.col(a)).otherwise(F.col(b)).alias(n) for (a, b), n in zip(ends, ("start", "finish"), strict=True)))
    ways = [False, True] if hop.either else [hop.backward]
    each = edges.filter(_kept(hop)).select(F.explode(F.array(*map(one, ways))).alias("e"), graph.level_rank("knowledge_level").alias("rank")).select("e.start", "e.finish", "rank")
    out = each.groupBy("start", "finish").agg(F.count(F.lit(1)).alias("n_paths"), F.min("rank").alias("rank"))
    if hop.types:
        out = out.join(_of_type(nodes, hop.types).select(F.col("identifier").alias("finish")), "finish", "left_semi")
    return out.select("start", "finish", "n_paths", "rank")


def _of_type(nodes: DataFrame | None, types: tuple[str, ...]) -> DataFrame:
    """Identifiers of a type; of rows that share one the first in file order decides."""
    if nodes is None:
        raise ValueError("a pattern with node types needs nodes")
    return nodes.groupBy("identifier").agg(F.min_by("node_type", "file_ord").alias("node_type")).filter(F.col("node_type").isin(*types))


def pattern(edges: DataFrame, hops: list[Hop], nodes: DataFrame | None = None, start_types: tuple[str, ...] = ()) -> DataFrame:
    """start, finish, n_paths, level: how many paths of normalised ``edges`` follow ``hops`` in turn, and the best of their
    levels, a path being as good as its weakest edge.

    Paths are never listed: two neighbouring parts of the pattern meet in their common node with counts that are
    multiplied, and are summed per pair of ends. The parts with the fewest pairs meet first.
    """
    if not hops:
        raise ValueError("a pattern has one hop or more")
    parts = [materialise(_pairs(edges, hop, nodes), "hop") for hop in hops]
    if start_types:
        first = parts[0].join(_of_type(nodes, start_types).select(F.col("identifier").alias("start")), "start", "left_semi")
        parts[0] = materialise(first.select("start", "finish", "n_paths", "rank"), "hop")
    sizes = [p.count() for p in parts]
    while len(parts) > 1:
        i = min(range(len(parts) - 1), key=lambda i: sizes[i] * sizes[i + 1])
        b = parts[i + 1].select(F.col("start").alias("finish"), F.col("finish").alias("end"), F.col("n_paths").alias("times"), F.col("rank").alias("other"))
        met = parts[i].join(b, "finish").groupBy("start", F.col("end").alias("to")).agg(F.sum(F.col("n_paths") * F.col("times")).alias("n_paths"), F.min(F.greatest("rank", "other")).alias("rank"))
        parts[i : i + 2] = [materialise(met.select("start", F.col("to").alias("finish"), "n_paths", "rank"), "hops")]
        sizes[i : i + 2] = [parts[i].count()]
    level = F.get(F.array(*map(F.lit, vocab.KNOWLEDGE_LEVELS)), F.col("rank").cast("int") - 1)
    return parts[0].select("start", "finish", "n_paths", level.alias("level"))
