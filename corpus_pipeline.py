"""A corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

1. The quality classifier rejects documents whose words the good labelled text lacks.
2. Line dedup takes lines out that many documents share.
3. The n-gram Jaccard join leaves the smallest doc_id of each group of near duplicates.
4. Decontamination rejects documents that hold a window of a benchmark item.
5. Packing lays the tokens of what is left into sequences.

Decisions are carried by doc_id (null like any other), and rows that share a doc_id share
them. All stages but the last return the columns of ``documents``. Stages 1 to 4 give an
empty table for an empty table, and the last one no sequence.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, line_dedup, ngram_join, packing, quality
from loomgraph.llm.common import materialise, shared_path


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` but for the doc_ids in ``rejected``, which is written first: the smaller side of the join."""
    gone = materialise(rejected.select(F.col("doc_id").alias("rejected_id")).distinct(), "rejected")
    return docs.join(gone, docs.doc_id.eqNullSafe(gone.rejected_id), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, quality.classified(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("not kept"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_shared_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, ngram_join.near_duplicates(docs).filter("component_id <> doc_id"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("n_hit > 0"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: Tokenizers cannot be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
