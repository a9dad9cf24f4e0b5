"""Raw nodes and edges to normal form: type aliases, inverse predicates, negation, base predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab


def node_type(raw: Column) -> Column:
    """The type after aliases; a token outside the vocabulary stays as it is, trimmed."""
    token = F.trim(raw)
    return F.coalesce(vocab.lookup(token, vocab.TYPE_ALIASES), token)


def normalise_nodes(nodes: DataFrame) -> DataFrame:
    """Adds node_type, type_valid, family, is_provenance to rows with raw_type."""
    return (
        nodes.withColumn("node_type", node_type(F.col("raw_type")))
        .withColumn("type_valid", F.col("node_type").isin(vocab.NODE_TYPES))
        .withColumn("family", vocab.family(F.col("node_type")))
        .withColumn("is_provenance", F.col("node_type").isin(vocab.PROVENANCE_TYPES))
    )


def predicate(raw: Column) -> Column:
    token = F.trim(raw)
    return F.coalesce(vocab.lookup(token, vocab.INVERSES), token)


def normalise_edges(edges: DataFrame) -> DataFrame:
    """Adds predicate, pred_valid, base, reversed and the final negated to rows with raw_predicate and negated_flag.

    A negation flag turns a negatable positive predicate into its ``not_`` form; a flag on anything else stays a flag.
    """
    plain = predicate(F.col("raw_predicate"))
    flag = F.coalesce("negated_flag", F.lit(False))
    return (
        edges.withColumn("reversed", F.trim("raw_predicate").isin(list(vocab.INVERSES)))
        .withColumn("predicate", F.when(flag & plain.isin(vocab.NEGATABLE), F.concat(F.lit("not_"), plain)).otherwise(plain))
        .withColumn("pred_valid", F.col("predicate").isin(vocab.ALL_PREDICATES))
        .withColumn("negative", F.col("predicate").isin([f"not_{p}" for p in vocab.NEGATABLE]))
        .withColumn("base", F.when(F.col("negative"), F.expr("substring(predicate, 5)")).otherwise(F.col("predicate")))
        .withColumn("negated", F.col("negative") | flag)
    )


def subtype(row: dict[str, Column]) -> Column:
    """subtype, else class_basis, else method, else the first *_kind key."""
    return F.coalesce(*(row[k] for k in ("subtype", "class_basis", "method", "kind") if k in row))


def first_wins(nodes: DataFrame) -> DataFrame:
    """One row per identifier, the first in file order: what a lookup sees."""
    rest = F.struct(*[c for c in nodes.columns if c not in ("identifier", "file_ord")])
    best = nodes.groupBy("identifier").agg(F.min("file_ord").alias("file_ord"), F.min_by(rest, "file_ord").alias("rest"))
    return best.select("identifier", "file_ord", "rest.*")
