"""Quality classifier by importance resampling.

Two hashed n-gram models are counted, one over the target (labelled rows of good quality
that are not toxic) and one over the raw text (every document). The n-grams are words and
pairs of adjacent words, the first four and five bytes of longer words, and the last three
bytes of visible tokens; a model holds how often each bucket occurs (pairs have buckets of
their own). A document's score is the sum of the log ratios target to raw over all its
n-grams, as often as they occur, where

* a text counts as at most ``span`` n-grams: each occurrence in a longer one counts less, so that
  no long document decides what the models hold,
* a ratio is smoothed by ``prior`` occurrences on either side, and its logarithm is drawn towards
  nothing by d ** 2 / (d ** 2 + ``doubt`` ** 2), where d is the square of the difference to what
  is due over the variance of that (``cluster`` times its square is added, as occurrences come in
  clusters): which of a text's copies happen to be labelled, or how often a rare word happens to
  be, tells nothing about the text,
* the document's own occurrences are taken out of both counts first, so that labelled rows
  are not scored by themselves, and
* the raw count of a document is weighted by the target's share of text in its language
  (``lang``, where ``docs`` has it), so that it does not matter which languages the labels
  happen to cover more.

The sum is taken to the length of ``length`` n-grams (``neutral`` n-grams of ratio 1 are added
to every document, so that a few words decide little), ``margin`` is added, and the log weight
is that, up to 0. Weights so lie in (0, 1]. The documents that stay are a sample without
replacement in proportion to weight ** sharpness, drawn by Gumbel top-k: key = sharpness *
log weight + Gumbel noise hashed from the doc_id; the k largest keys stay, and k is the sum of
the weights themselves (the number that rejection sampling would keep). The threshold is
found by counting keys in ever finer bins; no global sort, and ties at the threshold all stay.

The labelled sample is bounded by ``max_labels`` rows (chosen by hash); everything else
covers all rows. Counts are made per task in a fixed number of buckets and summed.

Defined results: a null or empty text has weight 1; rows without a label serve as raw text
only; n-grams of a language without labels of the target count for nothing unless another
language has them; repeated rows share key and decision; an empty table gives no rows;
without labels of the target nothing can be learned and every document stays; columns but
``lang`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_class, gram_hashes, materialise, mix, span_hashes, text_chunks, trimmed, two_columns, word_spans

#: Words and their parts have 2 ** BUCKET_BITS buckets, pairs of words as many again.
BUCKET_BITS = 20
BUCKETS = 2 << BUCKET_BITS
#: Characters that hold about one n-gram, of all kinds taken together.
GRAM_CHARS = 1.2
#: Steps per unit of key, when keys become integers for the threshold.
KEY_STEPS = 1 << 20


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram, as often as it occurs, and the document it is from."""
    keys, owners = [], []
    for kind in ("graphic", "alnum"):
        starts, ends, first = word_spans(data, offsets, byte_class(kind))
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        if kind == "graphic":
            keys.append(span_hashes(data, np.maximum(starts, ends - 3), ends, False) + np.uint64(1))
            owners.append(doc)
            continue
        words = span_hashes(data, starts, ends, True)
        keys.append(words)
        owners.append(doc)
        for n in (4, 5):
            long = ends - starts > n
            keys.append(span_hashes(data, starts[long], starts[long] + n, True) + np.uint64(n))
            owners.append(doc[long])
        within = doc[1:] == doc[:-1]
        pairs = mix(gram_hashes(words, 2)[within]) >> np.uint64(64 - BUCKET_BITS) | np.uint64(1 << BUCKET_BITS)
        pair_owners = doc[:-1][within]
    single = mix(np.concatenate(keys)) >> np.uint64(64 - BUCKET_BITS)
    return np.concatenate([single, pairs]).astype(np.int64), np.concatenate([*owners, pair_owners])


def marked(docs: DataFrame, labels: DataFrame, max_labels: int, span: float, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, text, target (labelled good), share (of the text in the row's language that is the target's)."""
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    thin = two_columns(docs, id_col, text_col, lang.alias("_lang"))
    sample = labels.select(F.col("doc_id").cast("long").alias("l_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("l_target")).filter("l_id is not null").orderBy(F.xxhash64("l_id"), "l_id").limit(max_labels)
    good = F.broadcast(sample.filter("l_target").select("l_id").distinct())  # at most max_labels rows
    rows = thin.join(good, thin.doc_id == good.l_id, "left").select("doc_id", "text", "_lang", F.col("l_id").isNotNull().alias("target"))
    chars = F.least(F.char_length("text").cast("double"), F.lit(span * GRAM_CHARS))
    shares = rows.groupBy(F.col("_lang").alias("s_lang")).agg(F.coalesce(F.sum(F.when(F.col("target"), chars)) / F.nullif(F.sum(chars), F.lit(0)), F.lit(0.0)).alias("share"))
    shares = materialise(shares, "language-shares")  # a row for each language
    return rows.join(shares, F.col("_lang").eqNullSafe(F.col("s_lang"))).select("doc_id", "text", "target", "share")


def _share_of(doc: np.ndarray, n: int, span: float) -> np.ndarray:
    """What one occurrence counts in each of n documents, from the document of every occurrence."""
    return np.minimum(1.0, span / np.maximum(1, np.bincount(doc, minlength=n)))


def feature_counts(rows: DataFrame, span: float) -> DataFrame:
    """bucket, expected (occurrences, each as its row's share), target (occurrences in target rows) over ``marked`` rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected, target = np.zeros((2, BUCKETS))
        for batch in trimmed(batches):
            good, share = np.asarray(batch.column("target"), dtype=bool), np.asarray(batch.column("share"))
            for i, j, data, offsets in text_chunks(batch.column("text")):
                bucket, doc = _features(data, offsets)
                counts = _share_of(doc, j - i, span)
                expected += np.bincount(bucket, weights=(counts * share[i:j])[doc], minlength=BUCKETS)
                target += np.bincount(bucket, weights=(counts * good[i:j])[doc], minlength=BUCKETS)
        some = np.flatnonzero(expected)
        for part in np.array_split(some, -(-len(some) // (1 << 16)) or 1):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(expected[part]), pa.array(target[part])], names=["bucket", "expected", "target"])

    return rows.mapInArrow(work, "bucket int, expected double, target double").groupBy("bucket").agg(F.sum("expected").alias("expected"), F.sum("target").alias("target"))


def model(counts: DataFrame) -> np.ndarray:
    """expected and target of every bucket."""
    out = np.zeros((2, BUCKETS), np.float32)
    table = counts.toArrow()  # at most BUCKETS rows
    out[:, table["bucket"].to_numpy()] = table["expected"].to_numpy(), table["target"].to_numpy()
    return out


def weights(
    docs: DataFrame, labels: DataFrame, prior: float = 2.0, doubt: float = 9.0, cluster: float = 0.015, span: float = 1000.0, margin: float = 1.5, length: float = 150.0, neutral: float = 100.0, max_labels: int = 50_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """doc_id, log_weight for every row of ``docs``; labels: doc_id, quality, toxic."""
    rows = marked(docs, labels, max_labels, span, id_col, text_col, lang_col)
    counts = model(materialise(feature_counts(rows, span), "ngram-counts"))
    scale = counts[1].sum(dtype=float) / max(counts[0].sum(dtype=float), 1e-9)  # lengths in characters give shares, and this what they are in n-grams
    table = docs.sparkSession.sparkContext.broadcast(counts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected, target = table.value
        for batch in trimmed(batches):
            score = np.zeros(batch.num_rows)
            good, share = np.asarray(batch.column("target"), dtype=float), np.asarray(batch.column("share"))
            for i, j, data, offsets in text_chunks(batch.column("text")):
                bucket, doc = _features(data, offsets)
                counts = _share_of(doc, j - i, span)
                held, times = np.unique(doc * BUCKETS + bucket, return_counts=True)
                bucket, doc = held % BUCKETS, held // BUCKETS
                own = times * counts[doc]
                seen = np.maximum(0.0, target[bucket].astype(float) - own * good[i:j][doc])
                due = np.maximum(0.0, expected[bucket].astype(float) - own * share[i:j][doc]) * scale
                sure = 1 / (1 + (doubt * (due + prior + cluster * due**2) / np.maximum((seen - due) ** 2, 1e-9)) ** 2)
                ratio = np.log((seen + prior) / (due + prior)) * sure
                total, n = (np.bincount(doc, weights=w, minlength=j - i) for w in (times * ratio, times))
                score[i:j] = length * total / (n + neutral)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.minimum(0.0, score + margin))], names=["doc_id", "log_weight"])

    out = materialise(rows.mapInArrow(work, "doc_id long, log_weight double"), "weights")
    table.destroy()
    return out


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> int:
    """The k-th largest of the integer column ``key`` (nulls aside), by counting in bins that narrow; at most ``bins`` rows a round."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while low < high:
        width = max(1, -(-(high - low + 1) // bins))
        found = keys.filter((F.col("key") >= low) & (F.col("key") <= high)).groupBy(F.expr(f"(key - {low}) div {width}").alias("bin")).count().orderBy(F.desc("bin")).collect()
        for b, n in found:
            if k <= n:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            k -= n
        else:
            return low
    return low


def classified(docs: DataFrame, labels: DataFrame, sharpness: float = 8.0, seed: int = 17, **options: object) -> DataFrame:
    """doc_id, log_weight, key, kept for every row of ``docs``."""
    noise = -F.log(-F.log((F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))))
    scored = weights(docs, labels, **options).withColumn("key", F.floor((F.lit(sharpness) * F.col("log_weight") + noise) * KEY_STEPS))
    n, k = scored.agg(F.count(F.lit(1)), F.sum(F.exp("log_weight"))).first()
    k = min(n, round(k or 0.0))
    threshold = kth_largest(scored, k) if k else None
    kept = F.col("key") >= F.lit(threshold) if k else F.lit(False)
    return scored.select("doc_id", "log_weight", "key", kept.alias("kept"))
