"""The driver's relational tables seen as a knowledge base: raw nodes, raw edges, sources and history.

The rules are fixed and deterministic; ``plans/oracle.py`` states the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import spread

NODE_COLUMNS = ["identifier", "raw_type", "subtype", "note", "description", "xref", "raw_source", "path"]
EDGE_COLUMNS = ["subject", "raw_predicate", "negated_flag", "object", "knowledge_level", "agent_type", "primary_source", "direction", "ci_lower", "ci_upper", "p_value"]


#: Tables that are dealt out to all cores where one file holds all of them.
LARGE = ["lineitem", "orders", "documents", "pages", "events", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(read) if name in LARGE else read


def named(label: str, key: str) -> Column:
    return F.concat(F.lit(f"{label} "), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw nodes with file_ord, the place of the path in file order."""
    read = lambda name: table(spark, sf_dir, name)
    null = F.lit(None).cast("string")

    def rows(df: DataFrame, **cols: Column) -> DataFrame:
        return df.select(*[cols.get(c, null).cast("string").alias(c) for c in NODE_COLUMNS])

    k = F.col("p_partkey")
    kind = F.substring_index("p_type", " ", 1)
    raw_type = (
        F.when(kind == "ECONOMY", "Molecule").when(kind == "SMALL", "Disease").when(kind == "LARGE", "Phenotype").when(kind == "MEDIUM", "Gene").when(kind == "STANDARD", "Procedure").otherwise("Promotion")
    )
    path = lambda folder, key: F.concat(F.lit(f"knowledge/{folder}/"), F.lpad(F.col(key).cast("string"), 9, "0"), F.lit(".md"))
    part = read("part").withColumn("t", raw_type)
    return (
        rows(read("region"), identifier=named("Region", "r_regionkey"), raw_type=F.lit("GeographicLocation"), subtype=F.lower("r_name"), description=F.col("r_name"), path=path("geographiclocation", "r_regionkey"))
        .union(rows(read("nation"), identifier=named("Nation", "n_nationkey"), raw_type=F.lit("GeographicLocation"), subtype=F.lit("Nation"), description=F.col("n_name"), path=path("geographiclocation/nation", "n_nationkey")))
        .union(rows(read("customer"), identifier=named("Customer", "c_custkey"), raw_type=F.lit("Population"), subtype=F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")), description=F.col("c_name"), path=path("population", "c_custkey")))
        .union(
            rows(
                read("supplier"),
                identifier=named("Supplier", "s_suppkey"),
                raw_type=F.lit("Agent"),
                note=F.col("s_name"),
                xref=F.when(F.col("s_suppkey") % 3 != 0, named("infores:", "s_suppkey")),
                raw_source=F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("raw/doc-"), F.col("s_suppkey").cast("string"), F.lit("/source.md"))),
                path=path("agent", "s_suppkey"),
            )
        )
        .union(rows(read("orders"), identifier=named("Order", "o_orderkey"), raw_type=F.lit(" Study"), subtype=F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.lower("o_orderpriority")), xref=named("order:", "o_orderkey"), path=path("study", "o_orderkey")))
        .union(
            rows(
                part,
                identifier=F.when(k % 101 == 0, F.concat(F.lit("PT:"), k.cast("string"))).when(k % 103 == 0, F.concat(k.cast("string"), F.lit(" mg"))).when(k % 97 == 0, F.concat(F.lit("Part "), (k - 1).cast("string"))).otherwise(named("Part", "p_partkey")),
                raw_type=F.when(k % 61 == 0, "Other").otherwise(F.col("t")),
                subtype=F.col("p_brand"),
                note=F.when(k % 122 == 0, F.col("p_name")),
                description=F.col("p_name"),
                path=F.when(k % 13 == 0, path("disease", "p_partkey")).otherwise(path("part", "p_partkey")),
            )
        )
    )


def with_raw_paths(df: DataFrame) -> DataFrame:
    """Rows with raw_sources, the raw paths in turn: every fifth has one first that does not exist, and its source as a folder."""
    folder = F.regexp_replace("raw_source", "/source[.]md$", "")
    one = F.array("raw_source")
    return df.withColumn("raw_sources", F.when(F.col("raw_source").isNull(), F.array().cast("array<string>")).when(F.col("raw_source").rlike("0/source[.]md$"), F.array(F.lit("raw/gone/source.md"), folder)).otherwise(one))


def raw_files(sources_df: DataFrame) -> DataFrame:
    """path of every raw file and folder of ``sources``."""
    folder = F.concat(F.lit("raw/"), F.col("id"))
    return sources_df.select(F.explode(F.array(folder, F.concat(folder, F.lit("/source.md")), F.concat(folder, F.lit("/meta.yaml")))).alias("path"))


def file_order(df: DataFrame) -> DataFrame:
    """Rows with file_ord: order by path (then identifier) as one comparable string, without a global sort."""
    return df.withColumn("file_ord", F.concat_ws("\t", T.file_order(F.col("path")), "identifier"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: table(spark, sf_dir, name)
    null = F.lit(None).cast("string")
    q, p = F.col("l_quantity"), F.col("l_partkey")
    line = read("lineitem")
    mod = lambda n: F.pmod(q.cast("long"), F.lit(n))
    claims = line.select(
        F.when(F.col("l_linenumber") <= 3, named("Order", "l_orderkey")).otherwise(named("Supplier", "l_suppkey")).alias("subject"),
        F.when(F.col("l_returnflag") == "A", F.when(F.col("l_linenumber") == 2, "treated_by").otherwise("treats"))
        .when(F.col("l_returnflag") == "R", "not_treats")
        .when(mod(5) == 0, "regulates")
        .when(mod(5) == 1, " caused_by")
        .when(mod(5) == 2, "has_phenotype")
        .when(mod(5) == 3, "linked_to")
        .otherwise("associated_with")
        .alias("raw_predicate"),
        (F.col("l_tax") == 0.02).alias("negated_flag"),
        F.when(p % 89 == 0, F.concat(F.lit("HGNC:"), p.cast("string"))).otherwise(named("Part", "l_partkey")).alias("object"),
        F.when(mod(13) == 0, null).when(mod(17) == 0, "guess").when(F.col("l_linestatus") == "O", "knowledge_assertion").otherwise("statistical_association").alias("knowledge_level"),
        F.when(mod(19) == 0, null).when(mod(23) == 0, "robot").otherwise("manual_agent").alias("agent_type"),
        F.when(F.col("l_linenumber") == 7, null)
        .when(F.col("l_tax") == 0.08, "not_provided")
        .when(p % 50 == 0, named("Part", "l_partkey"))
        .when(p % 51 == 0, named("Missing", "l_suppkey"))
        .otherwise(named("Supplier", "l_suppkey"))
        .alias("primary_source"),
        F.when(F.col("l_discount") >= 0.05, "increased").alias("direction"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("ci_lower"),
        (F.col("l_extendedprice") * (1 - F.col("l_tax"))).alias("ci_upper"),
        (F.col("l_discount") * 12).alias("p_value"),
    )

    def link(df: DataFrame, subject: Column, predicate: str, obj: Column) -> DataFrame:
        fixed = {"subject": subject, "raw_predicate": F.lit(predicate), "object": obj, "negated_flag": F.lit(False), "knowledge_level": F.lit("knowledge_assertion"), "agent_type": F.lit("manual_agent"), "primary_source": F.lit("Supplier 1")}
        return df.select(*[fixed.get(c, F.lit(None)).cast(dict(claims.dtypes)[c]).alias(c) for c in EDGE_COLUMNS])

    return (
        claims.union(link(line.filter("l_linenumber = 1"), named("Part", "l_partkey"), "reported_in", named("Supplier", "l_suppkey")))
        .union(link(read("customer"), named("Customer", "c_custkey"), "located_in", named("Nation", "c_nationkey")))
        .union(link(read("supplier"), named("Supplier", "s_suppkey"), "located_in", named("Nation", "s_nationkey")))
        .union(link(read("nation"), named("Nation", "n_nationkey"), "part_of", named("Region", "n_regionkey")))
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingested documents as sources: id, sha256, body, tier, retracted, classified."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    sha = F.sha2("text", 256)
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        "doc_id",
        sha.alias("sha256"),
        F.col("text").alias("body"),
        F.when(F.col("quality") == 1, "peer_reviewed").when(F.col("quality") == 0, "web").alias("tier"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("retracted"),
        F.col("quality").isNotNull().alias("classified"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages with hosts of every kind, and identifiers and scholarly words at fixed places."""
    k = F.col("page_id")
    host = F.when(k % 7 == 0, "https://arxiv.org/abs/2401.01234").when(k % 7 == 1, "https://www.cdc.gov/x").when(k % 7 == 2, "https://lab.stanford.edu/p.pdf").when(k % 7 == 3, "http://www.bioRxiv.org/content").when(k % 7 == 4, "file:///local/x").otherwise(F.col("url"))
    tail = F.concat(
        F.when(k % 3 == 0, F.concat(F.lit(" doi: 10.1234/ABC."), k.cast("string"), F.lit(". "))).otherwise(""),
        F.when(k % 4 == 0, " PMID: 1234567 and PMC7654321 ").otherwise(""),
        F.when(k % 5 == 0, " Abstract. Received: May, Smith et al. ").otherwise(""),
        F.when(k % 11 == 0, " medRxiv ISBN 978-3-16-148410-0 arXiv:2101.00001 ").otherwise(""),
    )
    return table(spark, sf_dir, "pages").select("page_id", host.alias("url"), F.concat("html", tail).alias("body"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log: commit, kind, at, summary, delta."""
    e = table(spark, sf_dir, "events")
    return e.select(F.sha2(F.col("event_id").cast("string"), 256).alias("commit"), F.col("event_type").alias("kind"), F.col("ts").alias("at"), named("user", "user_id").alias("summary"), F.col("props").alias("delta"), F.col("user_id").cast("long").alias("user_id"), F.col("value").alias("value"))
