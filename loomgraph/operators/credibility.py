"""Source credibility: identifiers in the text, registry records, host patterns, scholarly wording, a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Registry work type -> (source type, tier).
REGISTRY_TYPES = {
    "journal-article": ("journal_article", "peer_reviewed"),
    "proceedings-article": ("journal_article", "peer_reviewed"),
    "article": ("journal_article", "peer_reviewed"),
    "review-article": ("review", "peer_reviewed"),
    "review": ("review", "peer_reviewed"),
    "posted-content": ("preprint", "preprint"),
    "preprint": ("preprint", "preprint"),
    "book": ("book", "peer_reviewed"),
    "book-chapter": ("book", "peer_reviewed"),
    "monograph": ("book", "peer_reviewed"),
    "edited-book": ("book", "peer_reviewed"),
    "dataset": ("dataset", "archive"),
}
#: Best first: the order in which tiers rank.
TIERS = ["peer_reviewed", "preprint", "archive", "gray_lit", "web", "unknown"]


def identifiers(df: DataFrame, probe: Column) -> DataFrame:
    return df.withColumn("doi", T.doi(probe)).withColumn("arxiv", T.arxiv(probe)).withColumn("pmid", T.pmid(probe)).withColumn("pmcid", T.pmcid(probe)).withColumn("isbn", T.isbn(probe))


def registry_verdicts(records: DataFrame) -> DataFrame:
    """doi, record (JSON of a registry) -> doi, source_type, tier, confidence, retracted, venue, publisher; unknown types give none."""
    get = lambda path: F.get_json_object("record", path)
    verdict = F.lit(None)
    for name, (source_type, tier) in REGISTRY_TYPES.items():
        verdict = F.when(F.col("work_type") == name, F.struct(F.lit(source_type).alias("source_type"), F.lit(tier).alias("tier"))).otherwise(verdict)
    publisher = F.coalesce(get("$.publisher"), get("$.host_venue.publisher"))
    return (
        records.withColumn("work_type", get("$.type"))
        .withColumn("v", verdict)
        .filter("v is not null")
        .select(
            F.lower("doi").alias("doi"),
            "v.source_type",
            "v.tier",
            F.when(T.allowlisted(F.coalesce(publisher, F.lit(""))), 0.95).otherwise(0.85).alias("confidence"),
            (F.coalesce(get("$.update-to"), F.lit("")).contains('"type":"retraction"') | (F.coalesce(get("$.is_retracted"), F.lit("")) == "true")).alias("retracted"),
            F.coalesce(get("$.container-title[0]"), get("$.host_venue.display_name")).alias("venue"),
            publisher.alias("publisher"),
        )
    )


def classify(df: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """url, filename, body -> source_type, tier, confidence, retracted, and the identifiers found."""
    probe = F.concat_ws(" ", F.coalesce("url", F.lit("")), F.coalesce("filename", F.lit("")), F.coalesce("body", F.lit("")))
    out = identifiers(df, probe)
    low, host = F.lower(F.coalesce("body", F.lit(""))), T.url_host(F.col("url"))
    markers = F.lit(0)
    for w in T.JOURNAL_WORDS:
        markers = markers + low.contains(w).cast("int")
    verdict = lambda source_type, tier, confidence: F.struct(F.lit(source_type).alias("source_type"), F.lit(tier).alias("tier"), F.lit(confidence).alias("confidence"))
    has_doi = F.col("doi").isNotNull()
    scholarly = F.when(T.contains_any(low, T.PREPRINT_WORDS) & (has_doi | (markers >= 1)), verdict("preprint", "preprint", 0.7)).when(has_doi & (markers >= 2), verdict("journal_article", "peer_reviewed", 0.72))
    by_host = (
        F.when(T.host_in(host, T.PREPRINT_HOSTS), verdict("preprint", "preprint", 0.9))
        .when(host.endswith(".gov") | host.endswith(".edu") | T.host_in(host, T.GRAY_HOSTS), verdict("gov_report", "gray_lit", 0.8))
        .when(host.isNotNull(), F.coalesce(scholarly, verdict("web_page", "web", 0.6)))
    )
    default = F.when(F.col("url").isNotNull() | F.col("filename").isNotNull(), verdict("web_page", "web", 0.5)).otherwise(verdict("personal", "unknown", 0.3))
    own = F.coalesce(by_host, scholarly, default)
    keep = [*df.columns, "doi", "arxiv", "pmid", "pmcid", "isbn"]
    if registry is None:
        return out.withColumn("v", own).select(*keep, "v.*", F.lit(False).alias("retracted"))
    reg = registry.select(F.col("doi").alias("r_doi"), F.struct("source_type", "tier", "confidence").alias("r"), F.col("retracted").alias("r_retracted")).dropDuplicates(["r_doi"])
    joined = out.join(reg, F.col("doi") == F.col("r_doi"), "left")
    return joined.withColumn("v", F.coalesce("r", own)).select(*keep, "v.*", F.coalesce("r_retracted", F.lit(False)).alias("retracted"))


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), tier)
