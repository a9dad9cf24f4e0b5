"""BM25 full-text ranking: postings, document frequencies and lengths as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import materialise

# Fixed values of the ranking formula.
K1, B = 1.5, 0.75


def search_text(nodes: DataFrame) -> DataFrame:
    """key, text of what is searched: identifier, subtype, synonyms, description, then body."""
    cols = [c for c in ("identifier", "subtype", "synonyms", "description", "body") if c in nodes.columns]
    keep = [c for c in ("identifier", "node_type", "file_ord") if c in nodes.columns]
    return nodes.select(F.col("identifier").alias("key"), F.concat_ws(" ", *cols).alias("text"), *keep)


def postings(docs: DataFrame) -> DataFrame:
    """key, term, tf; docs: key, text."""
    return docs.select("key", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))


def statistics(docs: DataFrame) -> DataFrame:
    """term, df, total tf."""
    return postings(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def query_terms(query: str) -> list[str]:
    import re

    return [t for t in re.split(r"[\W_]+", query.lower()) if t]


def bm25(docs: DataFrame, query: str, limit: int | None = 10) -> DataFrame:
    """key, score, rounded after ranking; ties keep key order. A term repeated in the query counts each time.

    Only the query's terms leave the scan: each document is one row of term counts, written once; df comes from the
    same rows. For many queries over the same documents, ``write_index`` and ``search_index`` read far less.
    """
    terms = query_terms(query)
    weight = {t: terms.count(t) for t in dict.fromkeys(terms)}
    if not weight:
        return docs.select("key", F.lit(0.0).alias("score")).filter("false")
    toks = T.tokens(F.col("text"))
    counted = docs.select("key", toks.alias("toks")).select("key", F.size("toks").alias("len"), *[F.size(F.filter("toks", _is(t))).alias(f"tf{i}") for i, t in enumerate(weight)])
    return _ranked(materialise(counted, "term-counts"), list(weight.values()), limit)


def _ranked(counted: DataFrame, weights: list[int], limit: int | None, totals: DataFrame | None = None) -> DataFrame:
    """key, score from rows of key, len, tf0, tf1, ...; totals: n and avgdl, where not all documents are among the rows."""
    sums = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(weights))]
    if totals is None:
        found = counted.agg(F.count(F.lit(1)).alias("n"), F.when(F.sum("len") > 0, F.avg("len")).otherwise(1.0).alias("avgdl"), *sums)
    else:
        found = counted.agg(*sums).crossJoin(totals)  # one row each
    totals = found
    score = F.lit(0.0)
    for i, w in enumerate(weights):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        tf = F.col(f"tf{i}")
        score = score + w * idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avgdl"))))
    any_hit = F.greatest(*[F.col(f"tf{i}") for i in range(len(weights))], F.lit(0)) > 0
    hits = counted.filter(any_hit).join(F.broadcast(totals)).select("key", score.alias("raw"))  # one row of totals
    if limit is not None:
        hits = hits.orderBy(F.desc("raw"), "key").limit(limit)
    return hits.select("key", F.round("raw", 3).alias("score"))


def write_index(docs: DataFrame, folder: str, buckets: int = 64) -> None:
    """Postings (key, term, tf, len) in folders by bucket of the term, and the totals: what ``search_index`` reads."""
    lengths = docs.select("key", T.tokens(F.col("text")).alias("toks")).select("key", F.size("toks").alias("len"), F.explode("toks").alias("term"))
    rows = lengths.filter("term is not null").groupBy("key", "len", "term").agg(F.count("term").alias("tf"))
    rows.withColumn("bucket", _bucket(F.col("term"), buckets)).repartitionByRange(buckets, "bucket", "term").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/postings")
    each = docs.select("key", F.size(T.tokens(F.col("text"))).alias("len")).distinct()  # texts are read again, postings are not written twice
    each.agg(F.count(F.lit(1)).alias("n"), F.when(F.sum("len") > 0, F.avg("len")).otherwise(1.0).alias("avgdl"), F.lit(buckets).alias("buckets")).write.parquet(f"{folder}/totals")


def _bucket(term: Column, buckets: int | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def search_index(spark: SparkSession, folder: str, query: str, limit: int | None = 10) -> DataFrame:
    """The same as ``bm25``, from a written index: only the folders of the query's terms are read."""
    terms = query_terms(query)
    weight = {t: terms.count(t) for t in dict.fromkeys(terms)}
    totals = spark.read.parquet(f"{folder}/totals")
    if not weight:
        return spark.read.parquet(f"{folder}/postings").select("key", F.lit(0.0).alias("score")).filter("false")
    buckets = totals.first()["buckets"]
    of = [r[0] for r in spark.createDataFrame([(t,) for t in weight], "term string").select(_bucket(F.col("term"), buckets)).distinct().collect()]  # a row for each term
    found = spark.read.parquet(f"{folder}/postings").filter(F.col("bucket").isin(of) & F.col("term").isin(list(weight)))
    counted = found.groupBy("key", "len").agg(*(F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(weight)))
    return _ranked(counted, list(weight.values()), limit, totals.select("n", "avgdl"))


def search_nodes(nodes: DataFrame, query: str, limit: int | None = 10) -> DataFrame:
    """identifier, node_type, score, snippet: nodes by relevance; ties keep file order."""
    texts = search_text(nodes).withColumn("key", F.col("file_ord"))
    hits = bm25(texts.select("key", "text"), query, limit)
    return texts.join(hits, "key").select("identifier", "node_type", "score", T.snippet(F.col("text"), query_terms(query)).alias("snippet"))


def _is(term: str):  # noqa: ANN202
    return lambda t: t == term
