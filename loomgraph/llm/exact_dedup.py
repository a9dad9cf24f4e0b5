"""Exact dedup by stateful streaming (DataFrame functions only).

The documents arrive as a stream. A streaming aggregation keeps, for each digest of the
normalised text, the row that stays (stable identifier and content locator) and the size of
its group; the state lies on disk (RocksDB), is checkpointed in the shared folder and never
expires. Rows are combined before the shuffle, so a text that a third of all rows carry
costs one row per task.

The checkpoint may be the caller's (``state``): a later call then reads only files that are new,
and restarts go on from the last batch. After the stream has caught up, the state is read back
as a table. On every hit (a digest
with more than one row) the full normalised bytes are compared within the digest; should
different texts ever share a digest, they are told apart by their bytes.

Defined results: null text counts as empty; of equal texts the row with most code points,
then the smallest doc_id, stays (a null doc_id sorts last); rows that repeat a doc_id and
text are one group whose keep_id is that doc_id, and the first by locator alone is kept;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, materialise, shared_path

#: Settings of the state store while the stream runs; memory is bounded per executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # no disk reserved ahead of use
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _rows(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        normalised(F.col(text_col)).alias("norm"),
        F.char_length(text).cast("long").alias("n_chars"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"),
    ).select("doc_id", "norm", "n_chars", "at", digest(F.col("norm")).alias("digest"))


def _best() -> Column:
    """Order of preference: most code points, smallest doc_id (null last), locator."""
    return F.struct((-F.col("n_chars")).alias("neg_chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")


def _escaped(path: str) -> str:
    """``path`` as a glob that means it literally: Spark's readers take every path as a glob."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in path.rstrip("/"))


def digest_state(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, state: str | None = None, max_bytes_per_batch: int = 64 << 30) -> DataFrame:
    """Run the stream over the Parquet files at ``path`` until it has seen them all; then the state: digest, best, n."""
    schema = spark.read.parquet(_escaped(path)).schema
    before = {k: spark.conf.get(k, None) for k in STATE}
    where = state or shared_path(spark, "digest-state")
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes_per_batch).parquet(f"{_escaped(path)[:-1]}[{path.rstrip('/')[-1]}]")  # a folder or a file: the stream takes a file by a glob only
        kept = _rows(stream, id_col, text_col, digest).groupBy("digest").agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("n"))
        query = kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", where).trigger(availableNow=True).start()
        query.awaitTermination()
        try:
            stored = spark.read.format("statestore").option("path", where).load()
        except AnalysisException:  # no batch has ever run: no file held a row
            return kept_schema(spark)
        value = stored.schema["value"].dataType.names
        return materialise(stored.select(F.col("key.digest").alias("digest"), F.col(f"value.{value[0]}").alias("best"), F.col(f"value.{value[1]}").alias("n")), "digests")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def kept_schema(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "digest binary, best struct<neg_chars:long,no_id:boolean,doc_id:long,at:struct<file:string,row:long>>, n long")


def deduplicated(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, state: str | None = None, max_bytes_per_batch: int = 64 << 30) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of the Parquet files at ``path``.

    ``state``: a folder for the stream's checkpoint, kept from call to call over files that only ever are added.
    """
    kept = digest_state(spark, path, id_col, text_col, digest, state, max_bytes_per_batch)
    rows = _rows(spark.read.parquet(_escaped(path)), id_col, text_col, digest)
    # Hits: the full bytes of every row whose digest came more than once, combined within each task before they meet.
    hits = rows.select("digest", "norm").join(kept.filter("n > 1").select("digest"), "digest")
    clashes = materialise(
        hits.groupBy(F.concat(F.col("digest"), F.lit(b"")).alias("d")).agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).filter("lo <> hi").select(F.col("d").alias("digest")), "digest-clashes"
    )
    sha = F.sha2("norm", 256)
    thin = rows.select("doc_id", "digest", "at", sha.alias("text_sha256"))
    plain = thin.join(kept, "digest")
    answer = lambda df: df.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("best.at")).alias("kept"), "text_sha256")
    if clashes.isEmpty():
        return answer(plain)
    apart = rows.join(clashes, "digest", "left_semi")
    groups = apart.groupBy("norm").agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("n"))
    split = apart.withColumn("text_sha256", sha).join(groups, "norm")
    return answer(plain.join(clashes, "digest", "left_anti")).unionByName(answer(split))
