"""Near-duplicate groups by SetSketch registers.

A document is its set of distinct word shingles, as 64-bit hashes. Register i of a set holds
the minimum over its shingles of a hash with exponential distribution, on a scale whose steps
are powers of BASE, cut off to one byte: registers of two sets agree about as often as the sets
are alike, and the registers of a union are the maxima of both. Equal sets collapse to one
representative first.

* Registers are banded: representatives that agree in all ROWS registers of a band share a
  bucket. A pair at the threshold of 0.8 is missed by all BANDS bands with a probability of
  about 3e-9, a likelier pair more rarely still.
* Stars: the few leads of a bucket are its first documents in a few global orders, so that the
  buckets of a large group share their leads; every other document is paired with them. Leads
  are written before they are joined, so that adaptive execution splits hot buckets.
* The joint likelihood of both registers (how many are larger, smaller and equal, given the
  sizes of the sets, which are known) says how alike the sets of a pair are. A pair goes only
  where the likelihood of the threshold itself is lower than that of the best estimate by a
  factor of e ** SLACK. Of what stays, each document's best few pairs are verified on full sets.
* Once components are known, buckets that still hold several of them are joined again, across
  components only, behind bounds within the join condition: the odd sketch of a set (for each of
  ODD_BITS classes by hash, whether the number of its shingles is odd) differs from another's in
  at most as many bits as there are shingles that only one of both sets has, and a coarse form of
  the same likelihood (one bit of each register, held in a few numbers) serves long texts, whose
  odd sketches are full. What stays is estimated and verified alike. Copies of one component make no pairs.

Shingles are compared by 64-bit hashes of words (see ``common.span_hashes``), not by text.

Defined results: null and empty texts and texts without words have an empty set and are
linked with nothing; texts of fewer words than a shingle have one shingle, the sequence
itself; rows that share a doc_id are one document, linked where any of its rows is; a null
doc_id is linked with nothing (component_id and kept null); further columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, mix, release, slot_bitmap, text_chunks, trimmed, two_columns
from .components import components
from .ngram_join import shingle_sets

BANDS, ROWS = 72, 7
REGISTERS = BANDS * ROWS
BASE, RATE = 1.2, 20.0  # step of the registers' scale, and rate of the exponential hashes
SLACK = 20.0
LEADS, BEST = 4, 4  # of a bucket, and pairs with leads that a document is verified in
COARSE = [f"coarse_{i}" for i in range(-(-REGISTERS // 64))]
ODD_BITS = 1024  # a multiple of 64
ODD = [f"odd_{i}" for i in range(ODD_BITS // 64)]
#: Bytes of text that are hashed together: their shingles stay in a core's cache.
SKETCH_BYTES = 1 << 18
MULTIPLIERS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)
MAX_SLOT_BITS = 27


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of REGISTERS bytes for each set; an empty set has zeros."""
    out = np.zeros((len(sets), REGISTERS), np.uint8)
    some = np.flatnonzero([len(s) for s in sets])
    if not len(some):
        return out
    flat = np.concatenate([sets[i] for i in some])
    at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in some])[:-1]])
    low = np.empty((REGISTERS, len(some)), np.uint64)
    hashed = np.empty_like(flat)
    for i, by in enumerate(MULTIPLIERS):
        np.multiply(flat, by, out=hashed)
        np.minimum.reduceat(hashed, at, out=low[i])
    least = -np.log1p(-np.minimum((low.T.astype(np.float64) + 1) / 2.0**64, 1 - 1e-16)) / RATE
    out[some] = np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, 255)
    return out


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ODD_BITS bits, 64 to a number, for each set. Those of two sets differ in at most as many bits as there are
    shingles that only one of both has, and in an odd number of bits where that number is odd."""
    out = np.zeros((len(sets), len(ODD)), np.uint64)
    if sets:
        at = np.concatenate(sets) % np.uint64(ODD_BITS)
        row = np.repeat(np.arange(len(sets), dtype=np.int64) * len(ODD), [len(s) for s in sets])
        np.bitwise_xor.at(out.reshape(-1), row + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), registers, odd (its odd sketch)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            sizes, digests, rows, odd = [], [], [], []
            for _, _, data, offsets in text_chunks(batch.column("text"), SKETCH_BYTES):
                sets = shingle_sets(data, offsets, k)
                sizes += map(len, sets)
                digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                rows += [r.tobytes() for r in registers(sets)]
                odd += [r.tobytes() for r in odd_sketches(sets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, rows, odd))], names=["doc_id", "n_shingles", "digest", "registers", "odd"])

    return docs.mapInArrow(work, "doc_id long, n_shingles long, digest binary, registers binary, odd binary")


# --- likelihood ------------------------------------------------------------------------------


def larger_share(x: np.ndarray) -> np.ndarray:
    """Probability that a register of one set is above the other's, x being the share of the union's shingles that would
    put it there."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)


GRID = np.linspace(0, 1, 101)


def log_likelihood(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Of ``above`` registers larger in a, ``below`` larger in b, and the rest equal, for sets of n_a and n_b shingles of a
    given similarity. All arrays broadcast; -inf where sizes rule the similarity out."""
    a, b = n_a / (n_a + n_b), n_b / (n_a + n_b)
    x, y = a - b * similarity, b - a * similarity
    p, q = larger_share(x), larger_share(y)
    term = lambda n, share: np.where(n > 0, n * np.log(np.maximum(share, 1e-300)), 0.0)
    return np.where((x < -1e-9) | (y < -1e-9), -np.inf, term(above, p) + term(below, q) + term(REGISTERS - above - below, 1 - p - q))


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest similarity of each pair of register rows, and whether the threshold could still be met."""
    above, below = ((a > b).sum(1)[:, None], (a < b).sum(1)[:, None])
    sizes = n_a[:, None].astype(float), n_b[:, None].astype(float)
    found = log_likelihood(above, below, *sizes, GRID[None, :])
    best = found.argmax(1)
    at = log_likelihood(above, below, *sizes, np.array([[threshold]]))[:, 0]
    return GRID[best], (GRID[best] >= threshold) | (found.max(1) - at <= SLACK)


def coarse_bits(threshold: float) -> int:
    """How many of the registers' lowest bits may differ in a pair at the threshold, but for one in some 10 ** 9.

    Where a share x of the union lies in one set only, that set's register is above the other's by j steps or more with a
    probability of the integral, over the j-th step, of x / (x + (1 - x) * BASE ** step).
    """
    step = (np.arange(2000 * 100) + 0.5) / 100
    signs = np.where(np.arange(len(step)) // 100 % 2, -1.0, 1.0) / 100
    odd = lambda x: float((signs * x / (x + (1 - x) * BASE ** np.minimum(step, 1500))).sum())
    apart = 1 - threshold
    share = max(odd(x) + odd(apart - x) for x in np.linspace(0, apart, 21))
    return math.ceil(REGISTERS * share + 6 * math.sqrt(REGISTERS * share * (1 - share)))


# --- pairs -----------------------------------------------------------------------------------


def _similar_size(n_a: Column, n_b: Column, percent: int) -> Column:
    return (100 * n_a >= percent * n_b) & (100 * n_b >= percent * n_a)


def postings(reps: DataFrame) -> DataFrame:
    """bucket, doc, n of every band of every representative."""
    band = lambda i: F.xxhash64(F.lit(i), F.substring("registers", ROWS * i + 1, ROWS))
    return reps.select(F.explode(F.array(*map(band, range(BANDS)))).alias("bucket"), F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"))


def shared_postings(reps: DataFrame) -> DataFrame:
    """The postings of buckets with more than one document, which are few. Buckets are only counted before that: all of
    them are shuffled for it, in one number each."""
    several = materialise(postings(reps).groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("bucket"), "shared-buckets")
    return materialise(postings(reps).join(several, "bucket", "left_semi"), "shared-postings")


def bucket_leads(listed: DataFrame) -> DataFrame:
    """bucket, leads (doc, n)."""
    row = F.struct("doc", "n")
    orders = [F.min_by(row, F.xxhash64("doc", F.lit(i)) if i else F.col("doc")) for i in range(LEADS)]
    return materialise(listed.groupBy("bucket").agg(F.array_distinct(F.array(*orders)).alias("leads")), "leads")


def star_pairs(listed: DataFrame, leads: DataFrame, percent: int) -> DataFrame:
    """doc, a, b (a < b, one of them doc): every document of a shared bucket with the bucket's leads."""
    near = lambda x: (F.col("doc") != x["doc"]) & _similar_size(F.col("n"), x["n"], percent)
    each = listed.join(leads, "bucket").select("doc", F.explode(F.transform(F.filter("leads", near), lambda x: x["doc"])).alias("lead"))
    return each.distinct().select("doc", F.least("doc", "lead").alias("a"), F.greatest("doc", "lead").alias("b"))


def mixed_postings(listed: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, doc, component of buckets that hold several components."""
    named = listed.join(found, listed.doc == found.node, "left").select("bucket", "doc", F.coalesce("component", "doc").alias("component"))
    named = materialise(named, "bucket-components")
    mixed = materialise(named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket"), "mixed-buckets")
    return materialise(named.join(mixed, "bucket", "left_semi"), "mixed-postings")


def cross_pairs(mixed: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """a, b (a < b): pairs of one bucket that are in different components.

    Sets of n and n_b shingles link where at most (100 - percent) / (100 + percent) of n + n_b shingles are in one of them
    only, which is the same as their similarity; odd sketches that differ in more bits rule that out. So the copies of a
    large group that are too far for a link make next to no pairs.
    """
    sized = reps.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), *COARSE, *ODD)
    left = materialise(mixed.join(sized, "doc"), "sized-postings")
    right = left.select("bucket", *(F.col(c).alias(f"{c}_b") for c in ("doc", "n", "component", *COARSE, *ODD)))
    differ = lambda columns: sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in columns), F.lit(0))
    enough = ((100 + percent) * differ(ODD) <= (100 - percent) * (F.col("n") + F.col("n_b"))) & (differ(COARSE) <= coarse_bits(percent / 100))
    apart = (F.col("doc") < F.col("doc_b")) & (F.col("component") != F.col("component_b"))
    met = left.join(right, "bucket").filter(apart & _similar_size(F.col("n"), F.col("n_b"), percent) & enough)
    return met.select(F.col("doc").alias("a"), F.col("doc_b").alias("b")).distinct()


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the joint likelihood does not rule out, with their estimate."""
    one = reps.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("registers").alias("r_a"))
    two = reps.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("registers").alias("r_b"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            n = batch.num_rows
            if not n:
                continue
            rows = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, REGISTERS) for c in ("r_a", "r_b")]
            found, keep = estimate(*rows, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent / 100)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], names=["a", "b", "estimate"]).filter(pa.array(keep))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(work, "a long, b long, estimate double")


def _slot(c: Column, slot_bits: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << slot_bits))


def sets_of(docs: DataFrame, wanted: DataFrame, k: int, slot_bits: int) -> DataFrame:
    """doc, shingles of the documents whose ids are in the only column of ``wanted``, and a few more: a bitmap of fixed size
    lets them through, and joins decide."""
    spark = docs.sparkSession
    involved = spark.sparkContext.broadcast(slot_bitmap(wanted.select(_slot(F.col(wanted.columns[0]), slot_bits)), slot_bits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            slot = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((involved.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))
            for i, j, data, offsets in text_chunks(batch.column("text")):
                sets = shingle_sets(data, offsets, k)
                at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))], names=["doc", "shingles"])
        release()

    with_slot = docs.withColumn("slot", _slot(F.col("doc_id"), slot_bits))
    out = materialise(with_slot.mapInArrow(work, "doc long, shingles array<long>"), "sets")
    involved.destroy()
    return out


def verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as alike as ``percent`` asks for."""
    one = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("s_a"))
    two = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("s_b"))
    counted = pairs.join(one, "a").join(two, "b").select("a", "b", F.size("s_a").cast("long").alias("m_a"), F.size("s_b").cast("long").alias("m_b"), F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("n"))
    return counted.filter(100 * F.col("n") >= percent * (F.col("m_a") + F.col("m_b") - F.col("n"))).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, k: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs``. BANDS and ROWS suit a ``percent`` of 80 or more."""
    if percent < 80:
        raise ValueError("the bands are laid out for a similarity of 80 percent or more")
    thin = two_columns(docs, id_col, text_col)
    head = materialise(sketched(thin, k), "sketches")
    groups = materialise(head.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "set-groups")
    members = head.join(groups, "digest", "left")
    first = members.filter("doc_id = rep").dropDuplicates(["digest"]).select("doc_id", "n_shingles", "registers", "odd")
    reps = materialise(with_bits(first), "representatives")
    slot_bits = min(MAX_SLOT_BITS, max(16, (32 * head.count()).bit_length()))
    known = thin.filter("doc_id is not null")
    listed = shared_postings(reps)
    stars = materialise(star_pairs(listed, bucket_leads(listed), percent), "stars")
    rated = likely(stars.select("a", "b").distinct(), reps, percent)
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("estimate"), "a", "b"))  # a document has at most BANDS * LEADS rows
    best = stars.join(rated, ["a", "b"]).withColumn("place", place).filter(F.col("place") <= BEST)
    tested = materialise(best.select("a", "b").distinct(), "best-pairs")
    ends = tested.select(F.explode(F.array("a", "b")))
    edges = materialise(verified(sets_of(known, ends, k, slot_bits), tested, percent), "links")
    found = components(edges)
    mixed = mixed_postings(listed, found)
    further = materialise(likely(cross_pairs(mixed, reps, percent).join(tested, ["a", "b"], "left_anti"), reps, percent).select("a", "b"), "further-pairs")
    if not further.isEmpty():
        sets = sets_of(known, further.select(F.explode(F.array("a", "b"))), k, slot_bits)
        edges = edges.unionByName(materialise(verified(sets, further, percent), "further-links"))
        found = components(edges)
    out = members.join(found, members.rep == found.node, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def with_bits(reps: DataFrame) -> DataFrame:
    """``reps`` with the lowest bit of every register, 64 to a column of COARSE, and ``odd`` as the columns of ODD."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            rows = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint8).reshape(n, REGISTERS) & 1
            coarse = np.packbits(np.pad(rows, ((0, 0), (0, 64 * len(COARSE) - REGISTERS))), axis=1).view(np.int64)
            odd = np.frombuffer(b"".join(batch.column("odd").to_pylist()), np.int64).reshape(n, len(ODD))
            bits = [pa.array(np.ascontiguousarray(c)) for c in (*coarse.T, *odd.T)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *bits], names=[*batch.schema.names[:3], *COARSE, *ODD])

    return reps.mapInArrow(work, "doc_id long, n_shingles long, registers binary, " + ", ".join(f"{c} long" for c in (*COARSE, *ODD)))
