"""Line dedup: drop lines that many documents share (DataFrame functions only).

Lines are exploded, normalised and hashed; distinct documents are counted per hash; lines
over the threshold go, except in the last document that holds them; what stays is put
together again by position.

Shuffles carry 16-byte hashes and positions, never line texts. The hashes are written once.
Documents are made distinct by hash and doc_id together, so a line that a third of all
documents share is spread over all tasks, and then counted per hash, combined before the
shuffle; the doomed hashes are written first, so that looking them up is a plain equi-join
whose hot hashes adaptive execution splits.

Defined results: a null text counts as empty, an empty text is one empty line; rows that
share a doc_id are one document for the count, and all rows with the largest doc_id keep
the line; rows with a null doc_id count as one document, which sorts below every other;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, materialise, two_columns


def _dropped(base: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """g_id, g_hash, gone (positions) for rows of (doc_id, text, row_hash) that lose lines."""
    lines = F.split("text", "\n", -1)
    keyed = base.filter(F.char_length("text") >= min_chars).select(
        "doc_id",
        "row_hash",
        F.filter(
            F.transform(lines, lambda x, i: F.struct(i.alias("pos"), ascii_lower(F.btrim(x, F.lit(SPACES))).alias("key"))),
            lambda s: F.char_length(s["key"]) >= min_chars,
        ).alias("long_lines"),
    )
    hashed = keyed.select("doc_id", "row_hash", F.explode(F.transform("long_lines", lambda s: F.struct(s["pos"].alias("pos"), F.unhex(F.md5(s["key"])).alias("hash")))).alias("h")).select("doc_id", "row_hash", "h.pos", "h.hash")
    hashed = materialise(hashed, "line-hashes")
    doomed = materialise(
        hashed.select("hash", "doc_id").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_id")).filter(F.col("n_docs") >= min_docs).select("hash", "last_id"),
        "doomed-lines",
    )
    return (
        hashed.join(doomed, "hash")
        .filter(~F.col("doc_id").eqNullSafe(F.col("last_id")))
        .groupBy("doc_id", "row_hash")
        .agg(F.collect_set("pos").alias("gone"))
        .select(F.col("doc_id").alias("g_id"), F.col("row_hash").alias("g_hash"), "gone")
    )


def _kept(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """rows (doc_id, text, row_hash and more) with lines, gone (null if nothing goes) and kept."""
    gone = _dropped(rows.select("doc_id", "text", "row_hash"), min_chars, min_docs)
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("row_hash") == F.col("g_hash")), "left").drop("g_id", "g_hash")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return out.withColumn("lines", F.split("text", "\n", -1)).withColumn("kept", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")))


def deduplicated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept (the text without dropped lines), n_lines, n_dropped; one row per row of ``docs``."""
    base = two_columns(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("row_hash"))
    return _kept(base, min_chars, min_docs).select("doc_id", "kept", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def without_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, the text replaced where lines go."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row_hash"))
    out = _kept(base, min_chars, min_docs)
    return out.select(*(F.when(F.col("gone").isNull(), F.col(f"row.{c}")).otherwise(F.col("kept")).alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns))
