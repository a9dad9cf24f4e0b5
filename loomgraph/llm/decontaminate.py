"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

An item's windows are its runs of ``window`` words (a shorter item is one window). A window
as a set of shingles of ``SHINGLE`` words is contained in a text only if all of its shingles
are, so for containment the necessary prefix is a single shingle: the rarest one, by how
often it occurs in all documents. Windows and documents are joined on those prefix shingles
alone, by an equi-join that Spark plans. The shingle's place in the window fixes where the
window would begin in the text; the length bound asks for room for the whole window, and
the window's words are then compared with the words that stand there.

Every shingle that a document sends has passed a bitmap of the shingles asked for. The bitmap
is what is broadcast: its size follows the benchmark up to 2 ** MAX_FILTER_BITS bits, beyond
which it fills up and more goes through to the join, which decides. Two passes over the
documents do, whatever the size of the benchmark.

Defined results: words are runs of digits, letters and characters past ASCII, A-Z in lower
case; a null text has none; repeated rows are answered each for itself; items that repeat
count once for each id; items without an id cannot be named and are left out; ids may be of
any type and are named as strings; an empty benchmark hits nothing; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_class, gram_hashes, materialise, slot_bitmap, span_hashes, text_chunks, trimmed, two_columns, word_spans

SHINGLE = 3
MIN_FILTER_BITS, MAX_FILTER_BITS = 16, 27
WORD = byte_class("alnum")
#: Windows of an item, and found shingles of documents, that a task holds before it sends them on.
FLUSH = 1 << 14


def item_windows(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, words (joined by a blank), size, shingles (hashes in order): a row for each window of each item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            ids = batch.column("item").to_pylist()
            for i, _, data, offsets in text_chunks(batch.column("text")):
                starts, ends, first = word_spans(data, offsets, WORD)
                hashed, raw = span_hashes(data, starts, ends, True), data.tobytes().lower()  # bytes.lower folds A-Z only
                for d in range(len(offsets) - 1):
                    a, b = int(first[d]), int(first[d + 1])
                    size = min(window, b - a)
                    grams = gram_hashes(hashed[a:b], min(SHINGLE, size)).view(np.int64) if size else []
                    per = size - min(SHINGLE, size) + 1
                    for lo in range(0, b - a - size + 1 if size else 0, FLUSH):
                        hi = min(lo + FLUSH, b - a - size + 1)
                        words = [raw[s:e].decode() for s, e in zip(starts[a + lo : a + hi + size], ends[a + lo : a + hi + size], strict=True)]
                        rows = [" ".join(words[w : w + size]) for w in range(hi - lo)]
                        sets = pa.array([grams[w : w + per] for w in range(lo, hi)], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([pa.array([ids[i + d]] * (hi - lo)), pa.array(rows), pa.array([size] * (hi - lo), pa.int32()), sets], names=["item", "words", "size", "shingles"])

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return items.filter("item is not null").mapInArrow(work, "item string, words string, size int, shingles array<long>")


def _filter(shingles: DataFrame):  # noqa: ANN202
    """A broadcast bitmap of the leading bits of the only column of ``shingles``, and how many bits those are."""
    bits = min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, (32 * shingles.count()).bit_length()))
    slot = F.shiftrightunsigned(F.col(shingles.columns[0]), 64 - bits)
    return shingles.sparkSession.sparkContext.broadcast((slot_bitmap(shingles.select(slot), bits), bits))


def _wanted(grams: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Positions of the shingles that pass the filter."""
    slot = (grams >> np.uint64(64 - bits)).astype(np.int64)
    return np.flatnonzero(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)


def frequencies(docs: DataFrame, shingles: DataFrame, lengths: list[int]) -> DataFrame:
    """shingle, n: how often each of ``shingles`` occurs in all documents."""
    shared = _filter(shingles)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for _, _, data, offsets in text_chunks(batch.column("text")):
                starts, ends, _ = word_spans(data, offsets, WORD)
                hashed = span_hashes(data, starts, ends, True)
                grams = [gram_hashes(hashed, n) for n in lengths]  # those across two texts add a little to rarity, no more
                key, n = np.unique(np.concatenate([g[_wanted(g, *shared.value)] for g in grams]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    counted = docs.select("text").mapInArrow(work, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    out = materialise(counted.join(shingles, "shingle", "left_semi"), "shingle-counts")
    shared.destroy()
    return out


def occurrences(docs: DataFrame, prefixes: DataFrame, lengths: list[int], window: int) -> DataFrame:
    """doc_id, row_hash, n_words, and pos, shingle, begin, context: a row for every document (without pos), and one for
    every shingle in it that may be a prefix, with the words around it."""
    shared = _filter(prefixes)
    names = ["doc_id", "row_hash", "n_words", "pos", "shingle", "begin", "context"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for i, j, data, offsets in text_chunks(batch.column("text")):
                ids, hashes = batch.column("doc_id")[i:j], batch.column("row_hash")[i:j]
                starts, ends, first = word_spans(data, offsets, WORD)
                hashed, raw = span_hashes(data, starts, ends, True), data.tobytes().lower()
                sizes = np.diff(first).astype(np.int64)
                nothing = pa.nulls(j - i, pa.int64())
                yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(sizes), nothing, nothing, nothing, pa.nulls(j - i, pa.string())], names=names)
                for n in lengths:
                    reach = window - SHINGLE if n == SHINGLE else 0
                    grams = gram_hashes(hashed, n)
                    at = _wanted(grams, *shared.value)
                    owner = np.searchsorted(first, at, side="right") - 1
                    within = at + n <= first[owner + 1]
                    at, owner = at[within], owner[within]
                    lo, hi = np.maximum(first[owner], at - reach), np.minimum(first[owner + 1], at + n + reach)
                    for k in range(0, len(at), FLUSH):
                        part = slice(k, k + FLUSH)
                        words = [" ".join([raw[s:e].decode() for s, e in zip(starts[x:y].tolist(), ends[x:y].tolist(), strict=True)]) for x, y in zip(lo[part], hi[part], strict=True)]
                        d, begin = pa.array(owner[part]), first[owner[part]]
                        yield pa.RecordBatch.from_arrays([ids.take(d), hashes.take(d), pa.array(sizes[owner[part]]), pa.array(at[part] - begin), pa.array(grams[at[part]].view(np.int64)), pa.array(lo[part] - begin), pa.array(words, pa.string())], names=names)

    found = docs.mapInArrow(work, "doc_id long, row_hash long, n_words long, pos long, shingle long, begin long, context string")
    out = materialise(found, "occurrences")
    shared.destroy()
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of items with an occurring window, sorted as strings); one row per row of ``docs``."""
    thin = two_columns(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("row_hash"))
    each = materialise(item_windows(benchmark, window, item_col), "item-windows")
    lengths = sorted(r[0] for r in each.select(F.least("size", F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]  # at most SHINGLE rows
    shingles = materialise(each.select(F.explode("shingles").alias("shingle")).distinct(), "item-shingles")
    counts = frequencies(thin, shingles, lengths)
    placed = each.select("words", "size", "shingles").dropDuplicates(["words"]).select("words", "size", F.posexplode("shingles").alias("at", "shingle")).join(counts, "shingle", "left")
    rarest = placed.groupBy("words", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "shingle")).alias("r"))
    # A window of whose shingles one occurs nowhere is in no document.
    windows = materialise(rarest.filter("r.n > 0").select("words", "size", F.col("r.at").alias("at"), F.col("r.shingle").alias("shingle")), "windows")
    found = occurrences(thin, windows.select("shingle").distinct(), lengths, window)
    met = found.filter("pos is not null").join(windows, "shingle")
    start = F.col("pos") - F.col("at")
    there = F.array_join(F.slice(F.split("context", " "), (start - F.col("begin") + 1).cast("int"), F.col("size")), " ")
    held = met.filter((start >= 0) & (start + F.col("size") <= F.col("n_words"))).filter(there == F.col("words")).select("doc_id", "row_hash", start.alias("a"), (start + F.col("size")).alias("b"), "words")
    named = held.join(each.select("words", "item").distinct(), "words")
    stretches = named.groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("a", "b")).alias("stretches"), F.sort_array(F.collect_set("item")).alias("items")).select(F.col("doc_id").alias("h_id"), F.col("row_hash").alias("h_hash"), "stretches", "items")
    # Stretches may overlap: merge them in order. A document's stretches are no more than its words for each length.
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    grown = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["b"]).alias("upto"))
    n_hit = F.aggregate(F.sort_array("stretches"), nothing, grown, lambda s: s["n"])
    rows = found.filter("pos is null").select("doc_id", "row_hash", "n_words").join(stretches, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("row_hash") == F.col("h_hash")), "left")
    return rows.select("doc_id", "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
