"""Lint kept up to date equals a full lint, whatever was edited."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from loomgraph.operators import lint, normalise, relint

NODE = "identifier string, raw_type string, subtype string, note string, xref string, raw_source string, path string, file_ord string"
EDGE = "subject string, raw_predicate string, negated_flag boolean, object string, knowledge_level string, agent_type string, primary_source string, direction string, ci_lower double, ci_upper double, p_value double"


def document(rng, path):
    """One node and its edges, full of what rules find."""
    name = rng.choice(["A", "B", "C", "D", "E", "F", "X:1", "7 mg", "Paper", "Study 1", "G", "H"])
    kind = rng.choice(["Gene", "Disease", "Phenotype", "Publication", "Study", "Other", "Nonsense", "Method"])
    node = (name, kind, rng.choice([None, "one-way", "one way", "two"]), rng.choice([None, "n"]), rng.choice([None, "x"]), None, f"knowledge/{rng.choice(['gene', 'disease', 'other'])}/{path}.md", path)
    edges = [
        (
            name, rng.choice(["treats", "not_treats", "caused_by", "regulates", "reported_in", "odd", "has_phenotype"]), rng.random() < 0.3, rng.choice(["A", "B", "C", "Paper", "nowhere", "Z"]), rng.choice([None, "observation", "guess"]),
            rng.choice([None, "manual_agent"]), rng.choice([None, "not_provided", "Paper", "A", "lost"]), rng.choice([None, "up"]), *rng.choice([(None, None), (2.0, 1.0)]), rng.choice([None, 0.5, 2.0]),
        )
        for _ in range(rng.randrange(4))
    ]
    return node, edges


def frames(spark, documents):
    nodes = normalise.normalise_nodes(spark.createDataFrame([n for n, _ in documents], NODE))
    return nodes, normalise.normalise_edges(spark.createDataFrame([e for _, es in documents for e in es], EDGE))


def counted(findings):
    return Counter((r["severity"], r["rule"], r["subject"], r["detail"]) for r in findings.collect())


@pytest.mark.parametrize("seed", range(3))
def test_edits_give_what_a_full_lint_gives(spark, seed):
    rng = random.Random(seed)
    documents = {f"p{i:02}": document(rng, f"p{i:02}") for i in range(25)}
    found = relint.findings(*frames(spark, list(documents.values())))
    assert counted(found) == counted(lint.lint(*frames(spark, list(documents.values()))))
    for step in range(2):
        paths = rng.sample(sorted(documents), 3)
        old = [documents.pop(p) for p in paths]
        new = {p: document(rng, p) for p in (paths[:2] if step else [*paths, "q1", "q2"])}
        documents |= new
        now = frames(spark, list(documents.values()))
        found = relint.updated(found, *now, relint.Change(*frames(spark, old), *frames(spark, list(new.values()))))
        assert counted(found) == counted(lint.lint(*now))


def test_nothing_changes_where_nothing_is_edited(spark):
    rng = random.Random(9)
    nodes, edges = frames(spark, [document(rng, f"p{i}") for i in range(10)])
    found = relint.findings(nodes, edges)
    none = relint.Change(nodes.limit(0), edges.limit(0), nodes.limit(0), edges.limit(0))
    assert counted(relint.updated(found, nodes, edges, none)) == counted(found)


def test_edits_shuffle_little_of_what_stays(spark):
    """Where the identifiers that an edit touches are too many to be broadcast (here: 3,000), edges that stay are not
    shuffled whole for them, nor is a finding with its keys spelt out (22 MB, now 11)."""
    from loomgraph.plans import catalog

    def shuffled():
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    threshold = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    try:
        for conf in threshold:
            spark.conf.set(conf, "8000")
        before = shuffled()
        assert catalog.QUERIES["lint_incremental"](spark, "/root/testdata/sf0.01").count() == 28
        assert 0 < shuffled() - before < 16e6
    finally:
        for conf in threshold:
            spark.conf.unset(conf)


def test_findings_that_are_not_written_are_the_same(spark):
    rng = random.Random(4)
    nodes, edges = frames(spark, [document(rng, f"p{i}") for i in range(10)])
    found = relint.findings(nodes, edges)
    none = relint.Change(nodes.limit(0), edges.limit(0), nodes.limit(0), edges.limit(0))
    unwritten = relint.updated(found, nodes, edges, none, write=False)
    assert found.columns == unwritten.columns == ["severity", "rule", "subject", "detail", "of"]
    assert counted(unwritten) == counted(found)
