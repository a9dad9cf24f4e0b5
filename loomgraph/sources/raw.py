"""The raw side of a bundle: ``raw/<id>/`` with the metadata, text and files of each ingested source."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metadata of a source, as its file says; what is absent has the value stated in ``sources``.
META = (
    "struct<id:string,title:string,sha256:string,format:string,original_filename:string,ingested_at:string,needs_llm_fallback:boolean,"
    "figures:array<struct<file:string,provisional:boolean,described:boolean,origin:string>>,url:string,final_url:string,source_type:string,"
    "credibility:struct<tier:string,confidence:double,retracted:boolean,venue:string,publisher:string,reasoning:string,classifier_version:int>,"
    "ids:struct<doi:string,pmid:string,pmcid:string,arxiv:string,isbn:string>>"
)
NEEDED = ["id", "title", "sha256", "format", "ingested_at", "needs_llm_fallback"]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to the bundle) of every raw file and of every folder above one, from file names alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/raw").select(_relative("path", root).alias("path"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return found.select(F.explode(above).alias("path")).distinct()


def _relative(column: str, root: str):  # noqa: ANN202
    base = root.removeprefix("file://").rstrip("/") + "/"
    return F.substring_index(F.col(column), base, -1)


def _files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """id, text of the file of that name in every source's folder."""
    texts = spark.read.option("pathGlobFilter", name).text(f"{root.rstrip('/')}/raw/*", wholetext=True)
    return texts.select(F.regexp_extract("_metadata.file_path", "/raw/([^/]+)/[^/]*$", 1).alias("id"), F.col("value").alias("text"))


def source_ids(spark: SparkSession, root: str) -> DataFrame:
    """id of every source that has metadata; file contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "meta.yaml").load(f"{root.rstrip('/')}/raw/*")
    return found.select(F.regexp_extract("path", "/raw/([^/]+)/[^/]*$", 1).alias("id")).distinct()


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """id, meta, error: the metadata of every source; a file that cannot be read as metadata has an error."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .bundle import _loader

        load = _loader()
        for pdf in batches:
            rows = []
            for source, text in zip(pdf["id"], pdf["text"], strict=True):
                try:
                    meta = load(text)
                    if missing := [k for k in NEEDED if not isinstance(meta, dict) or meta.get(k) is None]:
                        raise ValueError(f"missing {missing[0]}")
                    rows.append((source, json.dumps(meta, default=str), None))
                except Exception as e:
                    rows.append((source, None, (str(e) or type(e).__name__).split("\n")[0][:200]))
            yield pd.DataFrame(rows, columns=["id", "json", "error"])

    read = _files(spark, root, "meta.yaml").mapInPandas(work, "id string, json string, error string")
    return read.select("id", F.from_json("json", META).alias("meta"), "error")


def sources(spark: SparkSession, root: str) -> DataFrame:
    """A row for every source with readable metadata: id, title, sha256, format, url, figures, tier, confidence, retracted,
    classified, ids, and body (its text; null where there is none)."""
    read = metadata(spark, root).filter("error is null")
    body = _files(spark, root, "source.md").select(F.col("id").alias("_id"), F.col("text").alias("body"))
    cred = F.col("meta.credibility")
    out = read.select(
        "id",
        *(F.col(f"meta.{c}").alias(c) for c in ("title", "sha256", "format", "original_filename", "ingested_at", "needs_llm_fallback", "url", "final_url", "ids")),
        F.coalesce("meta.source_type", F.lit("unknown")).alias("source_type"),
        F.coalesce("meta.figures", F.array().cast("array<struct<file:string,provisional:boolean,described:boolean,origin:string>>")).alias("figures"),
        F.coalesce(cred["tier"], F.lit("unknown")).alias("tier"),
        F.coalesce(cred["confidence"], F.lit(0.3)).alias("confidence"),
        F.coalesce(cred["retracted"], F.lit(False)).alias("retracted"),
        (F.coalesce(cred["classifier_version"], F.lit(0)) > 0).alias("classified"),
    )
    return out.join(body, out.id == body._id, "left").drop("_id")
