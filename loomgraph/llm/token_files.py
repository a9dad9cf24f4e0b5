"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Format of one shard, all numbers little-endian: ``<shard>.bin`` holds the ids of its
documents in a row, two bytes each where every id fits and four otherwise; ``<shard>.idx``
holds the doc_ids (int64, one per document) and then the offsets in ids (uint64, one more
than documents). Shards follow each other in ascending doc_id order; a manifest table
gives each shard's name, documents, ids and base (the ids of all shards before it: a
prefix sum over one row per shard).

Documents are range-partitioned by doc_id, so a shard is one task's work: it streams its
documents, writes under a name of its own attempt and publishes by rename, so that a
repeated or speculative task does no harm. Files go to the shared folder through the
file system of its URL; readers map local files into memory and stream others.

Defined results: null text counts as empty and gives the end id alone; rows that repeat a
doc_id stay neighbours in the order of their text's hash; a null doc_id comes first; an
empty table writes no shard; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, small_batches, trimmed, two_columns
from .encode import encoded, forget

NO_ID = -(2**63)


def _files(url: str):
    """File system and path of a URL; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url if "://" in url else "file://" + url.removeprefix("file:"))


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shards: int | None = None, id_bytes: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents; returns the manifest: shard, name, n_docs, n_ids, base."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = np.dtype("<u2" if id_bytes == 2 else "<u4")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        files, path = _files(folder)
        files.create_dir(path, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:8]}"
        ids_of, sizes, total = [], [0], 0
        out = files.open_output_stream(f"{path}/.{name}.bin")
        for batch in trimmed(batches):
            keys = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            ids_of.append(keys)
            for _, ids in encoded(batch.column(1), tokenizer, end_id):
                if int(ids.max()) > np.iinfo(kind).max:
                    raise ValueError(f"id {ids.max()} does not fit {kind}")
                out.write(ids.astype(kind).tobytes())
                total += len(ids)
                sizes.append(total)
        out.close()
        forget()
        if total:
            with files.open_output_stream(f"{path}/.{name}.idx") as index:
                index.write(np.concatenate(ids_of).astype("<i8").tobytes())
                index.write(np.asarray(sizes, "<u8").tobytes())
            for end in ("idx", "bin"):
                files.move(f"{path}/.{name}.{end}", f"{path}/{name}.{end}")
            yield pa.RecordBatch.from_pylist([{"shard": shard, "name": name, "n_docs": len(sizes) - 1, "n_ids": total}], schema=MANIFEST)
        else:
            files.delete_file(f"{path}/.{name}.bin")

    thin = two_columns(docs, id_col, text_col)
    ranged = thin.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    with small_batches(spark):
        ranged.mapInArrow(work, "shard int, name string, n_docs long, n_ids long").write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema("shard int, name string, n_docs long, n_ids long").parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


MANIFEST = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_shards(manifest: DataFrame, folder: str, id_bytes: int = 2) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    kind = np.dtype("<u2" if id_bytes == 2 else "<u4")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        for batch in trimmed(batches):
            for row in batch.to_pylist():
                with files.open_input_file(f"{path}/{row['name']}.idx") as f:
                    index = f.read()
                docs = row["n_docs"]
                keys = np.frombuffer(index, "<i8", docs)
                at = np.frombuffer(index, "<u8", docs + 1, docs * 8).astype(np.int64)
                local = files.type_name == "local"
                data = np.memmap(f"{path}/{row['name']}.bin", kind, "r") if local else files.open_input_file(f"{path}/{row['name']}.bin")
                for lo in range(0, docs, 8192):
                    hi = min(docs, lo + 8192)
                    crc = np.empty(hi - lo, np.int64)
                    for k in range(lo, hi):
                        ids = data[at[k] : at[k + 1]] if local else np.frombuffer(data.read_at((at[k + 1] - at[k]) * kind.itemsize, at[k] * kind.itemsize), kind)
                        crc[k - lo] = zlib.crc32(ids.astype("<u4").tobytes())
                    part = keys[lo:hi]
                    yield pa.RecordBatch.from_arrays([pa.array(part, mask=part == NO_ID), pa.array(at[lo:hi] + row["base"]), pa.array(at[lo + 1 : hi + 1] - at[lo:hi]), pa.array(crc)], schema=ROWS)

    return manifest.select("name", "n_docs", "base").repartition(n, "name").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, id_bytes: int = 2, folder: str | None = None) -> DataFrame:
    """Write the files and read them back."""
    folder = folder or shared_path(spark, "token-files")
    return read_shards(write_shards(docs, folder, tokenizer, end_id, id_bytes=id_bytes), folder, id_bytes)
