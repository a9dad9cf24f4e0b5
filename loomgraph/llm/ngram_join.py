"""N-gram Jaccard join by vertical partitioning, down to connected components.

A document is its set of distinct word shingles, as 64-bit hashes. Equal sets collapse to
one representative first. Shingles have one global order, rare before frequent: a fixed-size
table of levels (the logarithm of document frequency, for frequent shingles only) comes
before the hash itself. Two sets over the threshold share a shingle within their prefixes of
that order, and length and position bound the overlap from there.

* Rare shingles (level 0) meet in an equi-join of prefixes on the shingle; a shingle's list is
  short by definition. Per pair, the shingles that both prefixes share are counted; a pair is
  tested only if length, position and that count leave room for the overlap it needs.
* Frequent shingles occur in a prefix only where a set consists of frequent shingles, as in
  large groups of near copies. Their lists are never collected: a few leads of each list
  come from combined minima, every other document is paired with them (stars), and once
  components are known only lists that still hold several components are joined again,
  across components only, where a sketch of each set leaves room for the overlap.

The order is cut into fragments. The overlap of a pair is counted per fragment, separately,
and summed; only documents of some pair send their shingles. What is broadcast is of fixed
size whatever the input: the level table and a bitmap of document slots, which only let too
many rows through where they fill up (equi-joins decide), so they cannot change the result.
Broadcasts are destroyed when the tables made with them are written.

Shingles are compared by 64-bit hashes of words (see ``common.span_hashes``), not by text: two
shingles that share a hash by chance count as one.

Defined results: null and empty texts and texts without words have an empty set and are
linked with nothing; texts of fewer words than a shingle have one shingle, the sequence
itself; rows that share a doc_id are one document; a null doc_id is linked with nothing
(component_id null); further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_class, gram_hashes, materialise, mix, powers, release, slot_bitmap, small_batches, span_hashes, text_chunks, trimmed, two_columns, word_spans
from .components import components

LEVEL_BITS = 24  # slots of the level table, one byte each
MAX_SLOT_BITS = 27  # slots of the document bitmap, one bit each, at most
RARE = 16  # shingles in fewer documents have level 0
FLUSH = 1 << 19  # shingles that a task holds before it sends them on
LEADS = 8  # documents of a frequent shingle's list that all others are paired with
FRAGMENTS = 4  # of the rare part of the order; the frequent part is one more


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    starts, ends, first = word_spans(data, offsets, byte_class("graphic"))
    words = span_hashes(data, starts, ends, True)
    grams = gram_hashes(words, k)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * powers(k + 1)[1 : b - a + 1]).sum() + np.uint64(b - a)])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, _, data, offsets in text_chunks(batch.column("text")):
        for row, s in enumerate(shingle_sets(data, offsets, k)):
            yield i + row, s


def _pack(x: np.ndarray) -> bytes:
    """uint32 values, byte plane by byte plane: high bytes that hardly vary then compress."""
    return np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _by_bucket(key: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) over sorted keys of bits + 32 bits."""
    bucket = (key >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[a]), int(a), int(b)


def _bucket_bits(df: DataFrame) -> int:
    """More buckets than partitions, so that a bucket stays as large as a partition's share, however much there is."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(LEVEL_BITS - 2, max(6, (2 * partitions - 1).bit_length()))


def heads(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            sets = [s for _, s in _sets(batch, k)]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "n_shingles", "digest"])

    return docs.mapInArrow(work, "doc_id long, n_shingles long, digest binary")


def level_table(docs: DataFrame, k: int) -> np.ndarray:
    """Level by the leading bits of a shingle: 0, or how far the logarithm of its document frequency lies above RARE.

    Shingles are counted by their leading bits plus 32 more; two that agree there are counted together. Where more
    than a quarter of a bucket's slots would be taken, the bucket starts its levels higher.
    """
    bits = _bucket_bits(docs)
    flush_at = max(FLUSH, 16 << bits)  # rows of a few shingles would cost more than they carry

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held) >> np.uint64(32 - bits), return_counts=True)
            rows = []
            for bucket, a, b in _by_bucket(key, bits):
                ids, many = key[a:b] & np.uint64(0xFFFFFFFF), np.flatnonzero(n[a:b] > 1)
                rows.append((bucket, _pack(np.diff(ids, prepend=np.uint64(0))), _pack(many), _pack(n[a:b][many])))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "ids", "many", "n"])

        for batch in trimmed(batches):
            for _, s in _sets(batch, k):
                if len(s):
                    held.append(s)
                    size += len(s)
                if size >= flush_at:
                    size = 0
                    yield flush()
        if held:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        ids, weights = [], []
        for row in table.to_pylist():
            part = np.cumsum(_unpack(row["ids"]), dtype=np.uint64)
            weight = np.ones(len(part), np.int64)
            weight[_unpack(row["many"])] = _unpack(row["n"])
            ids.append(part)
            weights.append(weight)
        key, inverse = np.unique(np.concatenate(ids), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate(weights)).astype(np.int64)
        rare = RARE
        while True:
            some = n >= rare
            slot = (key[some] >> np.uint64(32 - (LEVEL_BITS - bits))).astype(np.int64)
            if len(np.unique(slot)) <= 1 << (LEVEL_BITS - bits - 2):
                break
            rare *= 2
        release()
        slots = np.zeros(1 << (LEVEL_BITS - bits), np.uint8)
        np.maximum.at(slots, slot, np.minimum(15, 1 + np.log2(n[some] / RARE)).astype(np.uint8))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "slots": pa.array([zlib.compress(slots.tobytes(), 1)], pa.binary())})

    sent = docs.select("doc_id", "text").mapInArrow(send, "bucket int, ids binary, many binary, n binary")
    out = np.zeros(1 << LEVEL_BITS, np.uint8)
    size = 1 << (LEVEL_BITS - bits)
    with small_batches(docs.sparkSession):
        for bucket, slots in sent.groupBy("bucket").applyInArrow(count, "bucket int, slots binary").toLocalIterator():  # LEVEL_BITS slots in all
            out[bucket * size : (bucket + 1) * size] = np.frombuffer(zlib.decompress(slots), np.uint8)
    return out


def _slot(c, slot_bits: int):  # noqa: ANN001, ANN202
    return F.pmod(F.xxhash64(c), F.lit(1 << slot_bits))


def _marked(batch: pa.RecordBatch, bitmap: np.ndarray) -> np.ndarray:
    slot = batch.column("slot").to_numpy()
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _kept(batches: Iterator[pa.RecordBatch], bitmap: Broadcast, marked: bool) -> Iterator[pa.RecordBatch]:
    for batch in trimmed(batches):
        if (out := batch.filter(pa.array(_marked(batch, bitmap.value) == marked))).num_rows:
            yield out


def _prefix(s: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the prefix in global order, and their levels."""
    level = levels[(s >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)]
    order = np.argsort(level.astype(np.uint64) << np.uint64(60) | s >> np.uint64(4), kind="stable")[: len(s) - (3 * len(s) + 3) // 4 + 1]
    return s[order], level[order]


def _close(n_a: Column, n_b: Column, pos_a: Column, pos_b: Column) -> Column:
    """Whether length and position leave room for the overlap that the threshold asks for."""
    return _similar_size(n_a, n_b) & (7 * F.least(n_a - pos_a, n_b - pos_b) >= 3 * (n_a + n_b))


def _similar_size(n_a: Column, n_b: Column) -> Column:
    return (4 * n_a >= 3 * n_b) & (4 * n_b >= 3 * n_a)


def _rest(n):  # noqa: ANN001, ANN202
    """Shingles of a set outside its prefix."""
    return F.floor((3 * n + 3) / 4) - 1


SKETCH = [f"sketch_{i}" for i in range(16)]


def _sketch(s: np.ndarray) -> np.ndarray:
    """64 * len(SKETCH) bits of a set: the bits of its shingles' low ends. Two sets differ in as many shingles as bits, at least."""
    bits = np.zeros(64 * len(SKETCH), np.uint8)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _alike():  # noqa: ANN202
    """Whether the sketches of both sides leave room for the overlap that the threshold asks for."""
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in SKETCH), F.lit(0))
    both = F.col("n") + F.col("n_b")
    return differ <= both - 2 * F.ceil(3 * both / 7)


def _prefix_rows(sources: list[tuple[DataFrame, bool]], k: int, levels: Broadcast, copies: Broadcast, make, schema: str) -> DataFrame:  # noqa: ANN001
    """What ``make(doc, set, prefix, number of rare shingles in it)`` gives for every document, as columns of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def send(marked: bool):  # noqa: ANN202
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _kept(batches, copies, marked):
                ids = batch.column("doc_id").to_numpy()
                held, size = [], 0
                for row, s in _sets(batch, k):
                    if not len(s):
                        continue
                    shingles, level = _prefix(s, levels.value)
                    if (columns := make(ids[row], s, shingles, int(np.searchsorted(level, 1)))) is not None:
                        held.append(columns)
                        size += len(columns[0])
                    if size >= 1 << 16:
                        yield _columns(held, names)
                        held, size = [], 0
                if held:
                    yield _columns(held, names)

        return work

    out = None
    for docs, marked in sources:
        part = docs.mapInArrow(send(marked), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _columns(held: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)


def rare_pairs(sources: list[tuple[DataFrame, bool]], k: int, levels: Broadcast, copies: Broadcast) -> DataFrame:
    """a, b, n_a, n_b (a < b): pairs that share rare shingles of both prefixes, as many as the bounds ask for.

    What two sets share beyond their prefixes is at most the longer rest of one of them; the frequent shingles of the
    prefixes are counted as if all of the shorter list were shared.
    """

    def make(doc: int, s: np.ndarray, prefix: np.ndarray, rare: int) -> list[np.ndarray] | None:
        if rare:
            return [prefix[:rare].view(np.int64), np.full(rare, doc), np.full(rare, len(s), np.int32), np.arange(rare, dtype=np.int32), np.full(rare, len(prefix) - rare, np.int32)]
        return None

    rows = _prefix_rows(sources, k, levels, copies, make, "shingle long, doc long, n int, pos int, more int")
    # Both sides are the same but for names, so that one exchange serves both.
    side = lambda x: rows.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("doc", "n", "pos", "more")))
    long = lambda c: F.col(c).cast("long")
    met = side("a").join(side("b").hint("merge"), "shingle").filter((F.col("doc_a") < F.col("doc_b")) & _similar_size(long("n_a"), long("n_b")))
    close = _close(long("n_a"), long("n_b"), long("pos_a"), long("pos_b"))
    pair = met.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), long("n_a").alias("n_a"), long("n_b").alias("n_b"), F.least("more_a", "more_b").alias("more"), close.alias("close"))
    summed = pair.groupBy("a", "b", "n_a", "n_b", "more").agg(F.max("close").alias("close"), F.count(F.lit(1)).alias("shared"))
    needed = F.ceil(3 * (F.col("n_a") + F.col("n_b")) / 7) - F.greatest(_rest(F.col("n_a")), _rest(F.col("n_b")))
    return summed.filter(F.col("close") & (F.col("shared") + F.col("more") >= needed)).select("a", "b", "n_a", "n_b")


def frequent_postings(sources: list[tuple[DataFrame, bool]], k: int, levels: Broadcast, copies: Broadcast) -> DataFrame:
    """shingle, doc, n, pos, sketch: the frequent shingles of prefixes."""

    def make(doc: int, s: np.ndarray, prefix: np.ndarray, rare: int) -> list[np.ndarray] | None:
        if m := len(prefix) - rare:
            return [prefix[rare:].view(np.int64), np.full(m, doc), np.full(m, len(s), np.int64), np.arange(rare, rare + m), *(np.full(m, x) for x in _sketch(s))]
        return None

    return _prefix_rows(sources, k, levels, copies, make, "shingle long, doc long, n long, pos long, " + ", ".join(f"{c} long" for c in SKETCH))


def star_pairs(postings: DataFrame) -> DataFrame:
    """Every document of a list with its leads: the first documents of the list in LEADS orders. More than one, so that a
    document that is not close enough to one lead is likely to reach its group by another."""
    row = F.struct("doc", "n", "pos")
    first = [F.min_by(row, F.xxhash64("doc", F.lit(i)) if i else F.col("doc")) for i in range(LEADS)]
    lead = materialise(postings.groupBy("shingle").agg(*(f.alias(f"lead_{i}") for i, f in enumerate(first))), "leads")  # apart, so that the join can split hot shingles
    leads = F.array_distinct(F.array(*(f"lead_{i}" for i in range(LEADS))))
    close = lambda x: (F.col("doc") != x["doc"]) & _close(F.col("n"), x["n"], F.col("pos"), x["pos"])
    near = postings.join(lead, "shingle").select("doc", "n", F.explode(F.filter(leads, close)).alias("lead"))
    swap = F.col("doc") < F.col("lead.doc")
    either = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
    return near.select(either("doc", "lead.doc").alias("a"), either("lead.doc", "doc").alias("b"), either("n", "lead.n").alias("n_a"), either("lead.n", "n").alias("n_b"))


def cross_pairs(postings: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs within the bounds that share a frequent shingle and are still in different components; sketches of the sets
    spare testing most of those that are not close enough."""
    named = postings.join(found, postings.doc == found.node, "left").select("shingle", "doc", "n", "pos", *SKETCH, F.coalesce("component", "doc").alias("component"))
    mixed = materialise(named.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("shingle"), "mixed")
    left = materialise(named.join(mixed, "shingle", "left_semi"), "mixed-postings")
    right = left.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("doc", "n", "pos", "component", *SKETCH)))
    pairs = left.join(right, "shingle").filter((F.col("doc") < F.col("doc_b")) & (F.col("component") != F.col("component_b")) & _close(F.col("n"), F.col("n_b"), F.col("pos"), F.col("pos_b")) & _alike())
    return pairs.select(F.col("doc").alias("a"), F.col("doc_b").alias("b"), F.col("n").alias("n_a"), "n_b")


def links(docs: DataFrame, pairs: DataFrame, k: int, levels: Broadcast, slot_bits: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b; distinct) over the threshold: overlaps are counted per fragment of the order and summed."""
    spark = docs.sparkSession
    involved = spark.sparkContext.broadcast(slot_bitmap(pairs.select(_slot(F.col("a"), slot_bits)).union(pairs.select(_slot(F.col("b"), slot_bits))), slot_bits))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _kept(batches, involved, True):
            ids = batch.column("doc_id").to_numpy()
            doc, part, values = [], [], []
            for row, s in _sets(batch, k):
                where = np.where(levels.value[(s >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)] > 0, FRAGMENTS, (s >> np.uint64(62)).astype(np.int64))
                for f in range(FRAGMENTS + 1):
                    if len(some := s[where == f]):
                        doc.append(ids[row])
                        part.append(f)
                        values.append(some.view(np.int64))
            if doc:
                at = np.cumsum([0, *map(len, values)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values)))], names=["doc", "fragment", "shingles"])

    cuts = materialise(docs.mapInArrow(cut, "doc long, fragment int, shingles array<long>"), "fragments")
    involved.destroy()
    wanted = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS))))
    one = cuts.select(F.col("doc").alias("a"), "fragment", F.col("shingles").alias("s_a"))
    two = cuts.select(F.col("doc").alias("b"), "fragment", F.col("shingles").alias("s_b"))
    overlap = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    counted = wanted.join(one, ["a", "fragment"]).join(two, ["b", "fragment"]).select("a", "b", "n_a", "n_b", "fragment", overlap.alias("n"))
    once = counted.groupBy("a", "b", "n_a", "n_b", "fragment").agg(F.max("n").alias("n"))  # rows that repeat a document count once
    summed = once.groupBy("a", "b", "n_a", "n_b").agg(F.sum("n").alias("n"))
    return summed.filter(100 * F.col("n") >= 75 * (F.col("n_a") + F.col("n_b") - F.col("n"))).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id; one row per row of ``docs``. Threshold: Jaccard similarity of 0.75."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    thin = two_columns(docs, id_col, text_col)
    head = materialise(heads(thin, k), "heads")
    groups = materialise(head.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "set-groups")
    members = head.join(groups, "digest", "left")
    slot_bits = min(MAX_SLOT_BITS, max(16, (32 * head.count()).bit_length()))
    known = thin.filter("doc_id is not null").withColumn("slot", _slot(F.col("doc_id"), slot_bits))
    levels = share(level_table(known, k))
    extra = members.filter("doc_id <> rep").select("doc_id")
    copies = share(slot_bitmap(extra.select(_slot(F.col("doc_id"), slot_bits)), slot_bits))
    sources = [(known, False)]
    if copies.value.any():
        reps = groups.select(F.col("rep").alias("doc_id"))
        sources.append((known.mapInArrow(lambda batches: _kept(batches, copies, True), known.schema).join(reps, "doc_id", "left_semi"), True))
    distinct = lambda pairs, name: materialise(pairs.groupBy("a", "b").agg(F.min("n_a").alias("n_a"), F.min("n_b").alias("n_b")), name)
    postings = materialise(frequent_postings(sources, k, levels, copies), "frequent")
    tested = distinct(rare_pairs(sources, k, levels, copies).unionByName(star_pairs(postings)), "pairs")
    edges = materialise(links(known, tested, k, levels, slot_bits), "links")
    found = components(edges)
    further = distinct(cross_pairs(postings, found).join(tested, ["a", "b"], "left_anti"), "further-pairs")
    if not further.isEmpty():
        edges = edges.unionByName(materialise(links(known, further, k, levels, slot_bits), "further-links"))
        found = components(edges)
    for shared in (levels, copies):
        shared.destroy()
    return members.join(found, members.rep == found.node, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
