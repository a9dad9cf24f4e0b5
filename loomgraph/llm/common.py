"""What the operators of this subpackage share: shared folders, text columns, byte-level words.

Text is handled as UTF-8 bytes in numpy, a batch of documents at a time, inside
``mapInArrow`` tasks. Every separator used here is an ASCII character, so byte classes
and character classes agree.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one round of numpy work takes (a longer document goes alone).
CHUNK_BYTES = 1 << 20
BATCH_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes that are hashed at a time, and the longest span that is hashed by polynomial.
BLOCK, LONG_SPAN = 1 << 18, 512


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where that setting is absent a folder under the warehouse serves, in local mode only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands rows to Python tasks in batches of at most BATCH_ROWS: texts are long, and a batch is held
    on both sides. The session's own setting holds again afterwards."""
    before = spark.conf.get(ARROW_ROWS)
    if int(before) <= 0 or int(before) > BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there,
    and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def two_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """doc_id and text (and ``more``) only, so that no further column of the input can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def slot_bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """The slots (0 to 2 ** bits - 1) in the only column of ``slots``, as 2 ** bits bits."""
    at = F.col(slots.columns[0]) + 1
    packed = slots.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for part, some in packed.toLocalIterator():  # at most 2 ** bits bits
        out[(part - 1) * 4096 : part * 4096] = np.frombuffer(some, np.uint8)
    return out


def ascii_lower(c: Column) -> Column:
    """A-Z lowered, all else kept; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks and stages, and allocators keep what they had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task, with ``release`` every few of them and at the end."""
    for i, batch in enumerate(batches):
        yield batch
        if i % 8 == 7:
            release()
    release()


# --- byte-level work inside tasks ------------------------------------------------------------


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


mix = _mix
#: A random 64-bit value for each byte, and the odd base of the polynomial.
BYTE_VALUES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = _inverses = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, n at most BLOCK + LONG_SPAN; ``inverses`` undoes them, modulo 2 ** 64."""
    global _powers, _inverses
    if len(_powers) < n:
        p = np.full((2, BLOCK + LONG_SPAN), BASE, dtype=np.uint64)
        p[1] = _INVERSE
        p[:, 0] = 1
        _powers, _inverses = np.multiply.accumulate(p, axis=1)
    return _powers[:n]


def inverses(n: int) -> np.ndarray:
    powers(n)
    return _inverses[:n]


def text_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) over a string column without nulls, in pieces of about ``chunk_bytes``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    large = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk_bytes, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of word bytes, and for each document the number of its first word
    (one entry more than documents)."""
    m = is_word[data]
    n = len(m)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = m[:-1]
    starts = np.flatnonzero(m & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    if n:
        after[-1] = False
        after[:-1] = m[1:]
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and do not overlap. ``lower`` folds A-Z.

    Spans of up to LONG_SPAN bytes have a polynomial hash with random byte values, a block of bytes at a time, so that
    memory does not grow with the text; longer ones, among which structured texts could share a polynomial's value
    modulo 2 ** 64, a cryptographic one. As with any 64-bit hash, two of n spans share theirs by chance with a
    probability of about n * n / 2 ** 65.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    long = ends - starts > LONG_SPAN
    for i in np.flatnonzero(long).tolist():
        raw = data[starts[i] : ends[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(raw.lower() if lower else raw, digest_size=8).digest(), "little")
    short = np.flatnonzero(~long) if long.any() else slice(None)
    first_at, last_at, hashed = starts[short], ends[short], out[short]
    table, at = LOWERED if lower else BYTE_VALUES, 0
    while at < len(first_at):
        first = first_at[at]
        upto = max(at + 1, int(np.searchsorted(last_at, first + BLOCK, side="right")))
        a, b = first_at[at:upto] - first, last_at[at:upto] - first
        values = table[data[first : first + b[-1]]]
        values *= powers(len(values))
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values, out=sums[1:])
        hashed[at:upto] = _mix((sums[b] - sums[a]) * inverses(len(values))[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = upto
    out[short] = hashed
    return out


_folded = np.arange(256)
_folded[65:91] += 32
LOWERED = BYTE_VALUES[_folded]


def byte_class(word: str) -> np.ndarray:
    """Truth table over bytes. ``"graphic"``: all but ASCII white space; ``"alnum"``: digits, letters, and bytes past ASCII."""
    table = np.ones(256, dtype=bool)
    if word == "graphic":
        table[[32, 9, 10, 11, 12, 13]] = False
    else:
        table[:128] = False
        for a, b in ((48, 58), (65, 91), (97, 123)):
            table[a:b] = True
    return table


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; k - 1 entries fewer than words (none when there are fewer than k)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    p = powers(k + 1)
    for j in range(k):
        out += words[j : j + n] * p[j + 1]
    return _mix(out + np.uint64(k))
