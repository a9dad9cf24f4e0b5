"""Every stage on its own input against a plain version; the whole run; what the pipeline needs to be there."""

from __future__ import annotations

import re

import corpus_pipeline
import pytest

from . import helpers
from .test_operators import ids_of, plain_quality
from .test_operators import lines_kept as plain_lines


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    where = f"file://{tmp_path_factory.mktemp('pipe')}"
    data = [r[:5] for r in helpers.rows(21)] + [(None, "no id here at all", "en", "s", 3), (7000, None, "en", "s", 0)]
    texts = [r[1] for r in data if r[1] and 20 < len(r[1].split()) < 200]
    items = [(i, " ".join(texts[i * 6].split()[3:18])) for i in range(4)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in data[::3] if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, data, items


def lines_kept(data):
    return [(r[0], r[1] if not dropped else kept, *r[2:]) for r, (_, kept, _, dropped) in zip(data, plain_lines(data), strict=True)]


def test_stages(spark, inputs):
    where, data, items = inputs
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns = docs.columns
    named = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5

    kept = named["quality_classifier"](spark, docs, where)
    assert kept.columns == columns
    assert kept.count() == len(data)  # all of it is clean

    cut = named["line_dedup"](spark, docs, where)
    assert cut.columns == columns
    want = [(a, b, c, d, None if b is None else len(b)) for a, b, c, d, _ in lines_kept(data)]
    assert sorted(map(tuple, cut.collect()), key=repr) == sorted(want, key=repr)

    groups = helpers.near_components([r for r in data if r[0] is not None])
    near = named["ngram_jaccard_join"](spark, docs, where)
    assert near.columns == columns
    assert sorted(repr(r[0]) for r in near.collect()) == sorted(repr(r[0]) for r in data if r[0] is None or groups[r[0]][1] == r[0])

    hit = helpers.contamination(data, items)
    clean = named["benchmark_decontamination"](spark, docs, where)
    assert clean.columns == columns
    assert sorted(repr(r[0]) for r in clean.collect()) == sorted(repr(r[0]) for r in data if not hit[r[0]][1])
    assert any(h[1] for h in hit.values())


def test_run(spark, inputs):
    where, data, items = inputs
    rows = lines_kept(data)
    groups = helpers.near_components([r for r in rows if r[0] is not None])
    rows = [r for r in rows if r[0] is None or groups[r[0]][1] == r[0]]
    hit = helpers.contamination(rows, items)
    rows = [r for r in rows if not hit[r[0]][1]]
    got = corpus_pipeline.run(spark, where).collect()
    lengths: dict = {}
    for r in got:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {r[0]: len(ids_of("word_bpe_49k.json", 1, r[1])) for r in rows}


def test_quality_stage_rejects(spark, tmp_path):
    """Repeated rows among them; what stays is what the plain version keeps."""
    import random

    rng = random.Random(4)
    words, bad = ["alpha", "beta", "gamma", "delta", "zeta"], ["rotten", "vile"]
    data = [(i, " ".join(rng.choice(bad if i % 4 == 0 and rng.random() < 0.4 else words) for _ in range(40)), "en", "s", i) for i in range(200)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(1, 200, 2)] + [(i, 0, 1) for i in range(0, 40, 4)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["quality_classifier"](spark, docs, f"file://{tmp_path}")
    stay = plain_quality(data, labels)[1]
    assert {r[0] for r in kept.collect()} == stay
    assert not any(i % 4 for i in set(range(200)) - stay)
    assert len(stay) <= 160
    assert kept.columns == docs.columns


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_import_errors_are_not_swallowed():
    assert not re.search(r"except\s*(ImportError|Exception|:)", open(corpus_pipeline.__file__).read())
