"""Raw files as a stream: rows are deduplicated by URL and content in keyed state, then converted and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import ingest, office

#: A stored source, with the metadata that raw folders of a bundle have.
STORED = (
    "id string, sha256 string, filename string, title string, markdown string, format string, needs_llm boolean, ingested_at string, "
    "figures array<struct<file:string,provisional:boolean,described:boolean,origin:string>>, found array<struct<ext:string,bytes:binary,origin:string>>"
)
COLUMNS = [c.split()[0] for c in STORED.split(", ")]


def prepared(files: DataFrame, root: str = "", marker: str = ingest.MARKER) -> DataFrame:
    """binaryFile rows -> the columns of STORED, and ord. What operating systems leave, and hidden files below ``root``, go."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    below = F.substring_index("path", root.removeprefix("file://").rstrip("/") + "/", -1) if root else name
    hidden = F.exists(F.split(below, "/"), lambda x: x.startswith("."))
    base = files.filter(~T.junk(F.col("path")) & ~hidden).select("path", name.alias("filename"), F.lower(T.path_extension(name)).alias("ext"), "content", F.sha2("content", 256).alias("sha256"))
    out = office.convert(base, None).withColumn("title", T.title_from(F.col("markdown"), F.col("filename"), F.lit(None).cast("string")))
    whole = office.with_figures(out, marker).withColumn("id", T.source_id(F.col("title"), F.col("content"))).withColumn("ingested_at", T.today())
    return whole.select(*COLUMNS, F.col("path").alias("ord"))


#: Settings of the state store while a stream runs: on disk, with bounded memory per executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # no disk reserved ahead of use
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def first_seen(rows: DataFrame) -> DataFrame:
    """The rows (url, sha256, ...) of a stream whose URL, where they have one, and then whose content has not been seen.

    Both are keyed state without expiry: what a batch costs follows its own rows, not what is stored already.
    """
    address = F.coalesce(F.concat(F.lit("url "), F.col("url")), F.concat(F.lit("content "), F.col("sha256")))
    return rows.withColumn("_address", address).dropDuplicates(["_address"]).drop("_address").dropDuplicates(["sha256"])


def stored_once(rows: DataFrame, store: str, checkpoint: str, root: str = "") -> StreamingQuery:
    """Append each new content of a stream (path, content, url) to the Parquet table at ``store`` once.

    A batch writes a folder of its own, so one that is run again after a failure replaces what it wrote.
    """
    spark = rows.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    fresh = first_seen(rows.select("path", "content", "url", F.sha2("content", 256).alias("sha256")))

    def batch(df: DataFrame, epoch: int) -> None:
        urls = df.select(F.col("path").alias("ord"), "url")
        out = prepared(df, root).join(urls, "ord").select(*COLUMNS, "url")
        out.write.mode("overwrite").parquet(f"{store}/epoch={epoch}")

    spark.createDataFrame([], STORED + ", url string").write.mode("overwrite").parquet(f"{store}/epoch=-1")
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        return fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:  # a stream has its settings from when it began
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest_stream(spark: SparkSession, folder: str, store: str, checkpoint: str) -> StreamingQuery:
    """Append each new content under ``folder`` to the Parquet table at ``store`` once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    return stored_once(files.select("path", "content", F.lit(None).cast("string").alias("url")), store, checkpoint, folder)


def seen(spark: SparkSession, checkpoint: str) -> DataFrame:
    """sha256 of every content that a stream has seen, from its state."""
    for row in spark.read.format("state-metadata").load(checkpoint).select("operatorId").collect():  # two rows
        state = spark.read.format("statestore").option("operatorId", row["operatorId"]).load(checkpoint)
        if "sha256" in state.schema["key"].dataType.names:
            return state.select("key.sha256")
    raise ValueError(f"no stream has kept contents at {checkpoint}")
