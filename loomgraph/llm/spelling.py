"""Spelling variants grouped by letter-parity masks.

A word's mask has one bit for each letter (letters may share one): whether the letter occurs an
odd number of times. One inserted or deleted letter flips one bit, a replaced one at most two,
so of the mask's three bands at least one is equal in words that are one edit apart. Likewise
either the first or the last ENDS letters are equal in them, as a word is longer than both ends
together. Words meet in an equi-join on (band, its bits, end, its letters); within the join the
whole masks may differ in two bits at most, the lengths by one, and the edit distance decides.
A pair that could meet in several bands or ends counts in the first of them only, so that pairs
need no shuffle of their own to be made distinct.

Words are counted per task before they are shuffled. Counts per word, the nearest frequent word
of each, and the table of forms are combined before their shuffles too; chains of forms are
followed by doubling, and each round is written.

Defined results: null and empty texts hold no word; a null id counts as empty where ids play a
part; repeated rows count as often as they occur; further columns are ignored; an empty table
gives an empty one. A word without near words has itself as its root, no form and n_near 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, trimmed, two_columns

BAND_BITS = 21
ENDS = 3
SHORTEST = 2 * ENDS + 1
#: Distinct words that a task holds before it sends their counts on.
FLUSH = 1 << 18
#: Letters of a word, A-Z lowered.
LETTERS = "a-zÀ-ÿ"


def planted(run: str, start: int) -> str:
    """The run, without one letter in one of 31 cases: the crc32 of ``<doc_id>:<run>`` says which; ``start`` is the crc32
    of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), start)
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, shortest: int = SHORTEST, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: how often each word of ``shortest`` letters or more occurs. ``plant`` takes letters out of some (see
    ``planted``), by document and word."""
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in trimmed(batches):
            for i in range(batch.num_rows):  # one text at a time as a Python string
                doc_id, text = batch.column("doc_id")[i].as_py(), batch.column("text")[i].as_py()
                found = Counter(runs.findall(text.encode().lower().decode()))  # bytes: of ASCII letters only
                if not plant:
                    held.update(found)
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in found.items():
                    if len(word := planted(run, start)) >= shortest:
                        held[word] += n
                if len(held) >= FLUSH:
                    yield flush()
            if len(held) >= FLUSH:
                yield flush()
        if held:
            yield flush()

    counted = two_columns(docs, id_col, text_col).mapInArrow(work, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def parity_masks(words: pa.Array) -> np.ndarray:
    """The mask of every word: a letter's bit lies in band ``code % 3``, at ``code // 3`` modulo BAND_BITS."""
    texts = words.to_pylist()
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    bits = np.left_shift(np.int64(1), BAND_BITS * (codes % 3) + codes // 3 % BAND_BITS)
    out = np.zeros(len(texts), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.bitwise_xor.reduceat(bits, np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
    return out


def masked(words: DataFrame) -> DataFrame:
    """word, n, mask."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(parity_masks(batch.column("word")))], names=["word", "n", "mask"])

    return words.select("word", "n").mapInArrow(work, "word string, n long, mask long")


def _band(mask: Column, i: int) -> Column:
    return F.shiftright(mask, BAND_BITS * i).bitwiseAND(F.lit((1 << BAND_BITS) - 1))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, m: words (of SHORTEST letters or more) one edit apart, in both directions; ``words`` is distinct."""
    ends = (F.left("word", F.lit(ENDS)), F.right("word", F.lit(ENDS)))
    keys = F.array(*(F.struct(F.lit(i).alias("band"), F.lit(j).alias("side"), F.xxhash64(F.lit(2 * i + j), _band(F.col("mask"), i), end).alias("key")) for i in range(3) for j, end in enumerate(ends)))
    listed = materialise(masked(words).select("word", "n", "mask", F.inline(keys)), "word-bands")
    a = listed
    b = listed.select("key", *(F.col(c).alias(f"{c}_b") for c in ("word", "n", "mask")))
    apart = F.col("mask").bitwiseXOR(F.col("mask_b"))
    first_band = F.when(_band(apart, 0) == 0, 0).when(_band(apart, 1) == 0, 1).otherwise(2)
    same = lambda f: f("word", F.lit(ENDS)) == f("word_b", F.lit(ENDS))
    first_side = F.when(same(F.left), 0).otherwise(1)
    length = F.abs(F.char_length("word") - F.char_length("word_b")) <= 1
    once = (F.col("band") == first_band) & (F.col("side") == first_side)
    close = (F.col("word") < F.col("word_b")) & (F.bit_count(apart) <= 2) & once & length & (F.levenshtein(F.col("word"), F.col("word_b"), 1) == 1)
    met = materialise(a.join(b, "key").filter(close).select("word", "n", F.col("word_b").alias("near"), F.col("n_b").alias("m")), "near-words")
    return met.union(met.select("near", "m", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for every row of ``forms`` (word, form; no circles): the last form that is reached."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(words: DataFrame, min_count: int = 2, factor: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words (word, n; distinct) of SHORTEST letters or more that occur
    ``min_count`` times or more.

    A word's form is its near word of largest n (of equals the first in code-point order), if that is at least ``factor``
    times as frequent, and more frequent at all.
    """
    if factor < 2:
        raise ValueError("a form must be more frequent than its variant, or forms could go in circles")
    kept = materialise(words.filter((F.col("n") >= min_count) & (F.char_length("word") >= SHORTEST)), "words")
    best = near_pairs(kept).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    near = materialise(kept.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best")).alias("best")), "nearest")
    out = near.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    ends = roots(out.filter("form is not null"))
    return out.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
