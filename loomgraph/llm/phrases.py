"""Phrase collocations by suffix sorting.

Within a piece of text, every word begins a suffix, cut to ``max_n`` words. Suffixes are dealt
out by language and first word and sorted in reverse order; all prefixes of equal suffixes are
then neighbours, and one pass with a stack of open prefixes (one for each length) counts every
phrase of up to ``max_n`` words. The counts of a phrase's parts are joined to it afterwards.

* A phrase with a word, or a pair of words, that is rarer than ``min_count`` is itself rarer.
  Words are counted first, then pairs by slots of a hash; bitmaps of fixed size of the frequent
  ones end suffixes there, before the shuffle. Where they fill up they let too much through,
  never too little.
* Equal suffixes are counted per task before they are shuffled. First words that make up more
  than one in HOT_SHARE of all words (so at most HOT_SHARE words) are spread over partitions by
  the rest of the suffix too; the partial counts of their shorter prefixes are summed up after.
* The best phrases of a language are taken from each of SPREAD parts of it first.

Scores are integers made of exact decimals of 38 digits; counts may reach 10 ** 15.

Defined results: a null text counts as empty and holds no phrase; a null language is ``und``;
repeated rows count as often as they occur; further columns are ignored; an empty table gives
an empty one. Ties are settled by count and then by the phrase in UTF-8 byte order.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, mix, release, slot_bitmap, trimmed

BREAK = "\n"
#: A-Z lowered, tab as space, and whatever ends a piece as BREAK; bytes past ASCII stay.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
#: Distinct suffixes or words that a task holds before it sends their counts on.
FLUSH = 1 << 18
#: Pairs of words that a task holds before it sends their counts on.
PAIRS_FLUSH = 1 << 22
PAIR_BITS = 27
MAX_SLOT_BITS = 27
HOT_SHARE = 512
SPREAD = 64


def tokens(text: str) -> list[str]:
    """Words of a text in turn, with BREAK between pieces."""
    return [w for w in text.encode().translate(TABLE).decode().replace(BREAK, " \n ").split(" ") if w]


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _each(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    for i in range(batch.num_rows):  # one text at a time as a Python string
        yield batch.column("lang")[i].as_py(), tokens(batch.column("text")[i].as_py())


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n; the row of a language's null word has the number of all its words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            rows = [(lang, word, n) for lang, counts in held.items() for word, n in [*((w, n) for w, n in counts.items() if w != BREAK), (None, sum(counts.values()) - counts[BREAK])]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

        for batch in trimmed(batches):
            for lang, words in _each(batch):
                held[lang].update(words)
                if sum(map(len, held.values())) >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(work, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class _Words(dict):
    """Words of one language in a task: numbers for those that are frequent (others are -1, as is BREAK), and a hash of each."""

    def __init__(self, lang: str, bitmap: np.ndarray) -> None:
        super().__init__({BREAK: -1})
        self.start, self.bitmap, self.slots = zlib.crc32(f"{lang}\t".encode()), bitmap, 8 * len(bitmap) - 1
        self.words: list[str] = []
        self.room = np.empty(1 << 12, np.uint64)  # hashes, with room for more

    @property
    def hashes(self) -> np.ndarray:
        return self.room[: len(self.words)]

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        h = zlib.crc32(raw, self.start)
        self[word] = number = len(self.words) if self.bitmap[(h & self.slots) >> 3] >> (h & 7) & 1 else -1
        if number >= 0:
            if number == len(self.room):
                self.room = np.concatenate([self.room, np.empty_like(self.room)])
            self.room[number] = h << 32 | zlib.crc32(raw, h)
            self.words.append(word)
        return number

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _pair_slots(numbers: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """For each word but the last, the slot of it and the word after it; -1 where either is not frequent."""
    a, b = numbers[:-1], numbers[1:]
    slot = mix(mix(hashes[a]) + hashes[b]) >> np.uint64(64 - bits)
    return np.where((a >= 0) & (b >= 0), slot.astype(np.int64), -1)


def frequent_pairs(texts: DataFrame, frequent: Broadcast, min_count: int, bits: int) -> DataFrame:
    """slot of the pairs of neighbouring words that occur ``min_count`` times or more; pairs that share a slot count together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Words] = {}
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            slots, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            known.clear()
            return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(n, pa.int64())], names=["slot", "n"])

        for batch in trimmed(batches):
            for lang, words in _each(batch):
                if lang not in known:
                    known[lang] = _Words(lang, frequent.value)
                of = known[lang]
                numbers = of.numbers(words)
                if len(numbers) > 1 and of.words:
                    slots = _pair_slots(numbers, of.hashes, bits)
                    held.append(slots[slots >= 0])
                    size += len(slots)
                if size >= PAIRS_FLUSH:
                    size = 0
                    yield flush()
        if held:
            yield flush()
        release()

    counted = texts.mapInArrow(work, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= min_count).select("slot")


def _columns(max_n: int) -> list[str]:
    return [f"w{i}" for i in range(1, max_n + 1)]


def _counted(rows: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of numbers from -1 to base - 2, and how often each occurs; as one number each, where that has room."""
    width = rows.shape[1]
    if base**width >= 1 << 63:
        return np.unique(rows, axis=0, return_counts=True)
    powers = base ** np.arange(width - 1, -1, -1, dtype=np.int64)
    keys, n = np.unique((rows + 1) @ powers, return_counts=True)
    return keys[:, None] // powers % base - 1, n


def suffixes(texts: DataFrame, frequent: Broadcast, pairs: Broadcast, bits: int, max_n: int) -> DataFrame:
    """lang, w1 to w<max_n> (empty past a suffix's end), n: suffixes of two words or more, counted per task. A suffix ends
    before a rare word, and before a word that makes a rare pair with the one before it."""
    names = ["lang", *_columns(max_n), "n"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Words] = {}
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, n = _counted(np.concatenate(parts), len(known[lang].words) + 1)
                words = pa.array([*known[lang].words, ""], pa.string())
                columns = [words.take(pa.array(np.where(grams[:, i] < 0, len(words) - 1, grams[:, i]))) for i in range(max_n)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *columns, pa.array(n, pa.int64())], names=names)
            held.clear()
            known.clear()

        for batch in trimmed(batches):
            for lang, words in _each(batch):
                if lang not in known:
                    known[lang] = _Words(lang, frequent.value)
                of = known[lang]
                numbers = of.numbers(words)
                if len(numbers) < 2 or not of.words:
                    continue
                slots = _pair_slots(numbers, of.hashes, bits)
                joined = np.zeros(len(numbers), bool)  # whether a word goes on to the next
                joined[:-1] = (slots >= 0) & (pairs.value[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)
                first = np.flatnonzero(joined)
                grams = np.full((len(first), max_n), -1, np.int64)
                goes = np.ones(len(first), bool)
                for i in range(max_n):
                    at = first + i
                    if i:
                        goes = goes & (at < len(numbers)) & joined[np.minimum(at - 1, len(numbers) - 1)]
                    grams[goes, i] = numbers[at[goes]]
                held[lang].append(grams)
                size += len(first)
                if size >= PAIRS_FLUSH // 4:
                    size = 0
                    yield from flush()
        yield from flush()
        release()

    return texts.mapInArrow(work, ", ".join(f"{c} {'long' if c == 'n' else 'string'}" for c in names))


def count_prefixes(rows: DataFrame, max_n: int, min_count: int) -> DataFrame:
    """lang, w1 to w<max_n>, n: counts of all prefixes of sorted suffixes; those of ``hot`` rows may come in several parts."""
    names = ["lang", *_columns(max_n)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[tuple, int, bool] | None] = [None] * max_n  # the open prefix of each length: words, count, hot

        def closed(words: list[tuple], counts: list[int]) -> pa.RecordBatch:
            padded = zip(*(w + ("",) * (max_n + 1 - len(w)) for w in words), strict=True)
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in padded), pa.array(counts, pa.int64())], names=[*names, "n"])

        def whole(depth: int, hot: np.ndarray) -> np.ndarray:
            """Whether no other task holds a part of the count."""
            return ~np.asarray(hot, bool) | (depth == max_n)

        for batch in trimmed(batches):
            if not (size := batch.num_rows):
                continue
            columns = [batch.column(c) for c in names]
            n, hot = batch.column("n").to_numpy(), batch.column("hot").to_numpy(zero_copy_only=False)
            new = np.zeros(size, bool)
            words, counts = [], []
            for depth in range(1, max_n + 1):
                for c in columns[:2] if depth == 1 else columns[depth : depth + 1]:
                    new[1:] |= pc.not_equal(c.slice(1), c.slice(0, size - 1)).to_numpy(zero_copy_only=False)
                if depth == 1:  # words have been counted
                    continue
                new[0] = True
                starts = np.flatnonzero(new)
                sums = np.add.reduceat(n, starts)
                first = tuple(c[0].as_py() for c in columns[: depth + 1])
                if top := stack[depth - 1]:
                    if top[0] == first:
                        sums[0] += top[1]
                    elif top[0][-1] and (top[1] >= min_count or not whole(depth, top[2])):
                        words.append(top[0])
                        counts.append(top[1])
                last = int(starts[-1])
                stack[depth - 1] = (tuple(c[last].as_py() for c in columns[: depth + 1]), int(sums[-1]), bool(hot[last]))
                done = np.flatnonzero((sums[:-1] >= min_count) | ~whole(depth, hot[starts[:-1]]))
                at = pa.array(starts[:-1][done])
                taken = [c.take(at).to_pylist() for c in columns[: depth + 1]]
                some = [(w, int(s)) for w, s in zip(zip(*taken, strict=True), sums[:-1][done], strict=True) if w[-1]]
                words += [w for w, _ in some]
                counts += [s for _, s in some]
            if words:
                yield closed(words, counts)
        rest = [(top[0], top[1]) for depth, top in enumerate(stack, 1) if top and top[0][-1] and (top[1] >= min_count or not whole(depth, top[2]))]
        if rest:
            yield closed([w for w, _ in rest], [s for _, s in rest])

    return rows.mapInArrow(work, ", ".join([*(f"{c} string" for c in names), "n long"]))


def _slot(lang: Column, word: Column, bits: int) -> Column:
    return F.pmod(F.crc32(F.concat(lang, F.lit("\t"), word)), F.lit(1 << bits))


def phrase_counts(docs: DataFrame, max_n: int = 3, min_count: int = 10, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of up to ``max_n`` words that occur ``min_count`` times or more, and (lang, n),
    the number of all words. Words of a phrase are joined by one space each."""
    spark = docs.sparkSession
    texts = _texts(docs, lang_col, text_col)
    words = materialise(word_counts(texts).filter((F.col("n") >= min_count) | F.col("word").isNull()), "words")
    totals, frequent = words.filter("word is null").select("lang", "n"), words.filter("word is not null")
    bits = min(MAX_SLOT_BITS, max(16, (32 * frequent.count()).bit_length()))
    shared = spark.sparkContext.broadcast(slot_bitmap(frequent.select(_slot(F.col("lang"), F.col("word"), bits)), bits))
    every = totals.agg(F.sum("n")).first()[0] or 0
    hot = frequent.filter(HOT_SHARE * F.col("n") > F.lit(every)).select("lang", F.col("word").alias("w1"), F.lit(True).alias("hot"))  # HOT_SHARE rows at most
    pairs = materialise(frequent_pairs(texts, shared, min_count, PAIR_BITS), "frequent-pairs")
    shared_pairs = spark.sparkContext.broadcast(slot_bitmap(pairs, PAIR_BITS))
    rows = suffixes(texts, shared, shared_pairs, PAIR_BITS, max_n).join(F.broadcast(hot), ["lang", "w1"], "left").withColumn("hot", F.col("hot").isNotNull())
    salt = F.when(F.col("hot"), F.xxhash64(*_columns(max_n)[1:])).otherwise(0)
    order = [F.desc(c) for c in ("w1", "lang", *_columns(max_n)[1:])]
    dealt = rows.repartition("lang", "w1", salt).sortWithinPartitions(*order)
    parts = count_prefixes(dealt, max_n, min_count)
    summed = parts.groupBy("lang", *_columns(max_n)).agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
    spelled = F.filter(F.array(*_columns(max_n)), lambda w: w != "")
    longer = summed.select("lang", F.array_join(spelled, " ").alias("phrase"), F.size(spelled).alias("size"), "f").filter("size > 1")
    out = materialise(longer.unionByName(frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("f"))), "phrases")
    for broadcast in (shared, shared_pairs):
        broadcast.destroy()
    return out, totals


def _subphrases(max_n: int) -> Column:
    """Every run of two or more words of the phrase that is shorter than itself."""
    words = F.split("phrase", " ")
    run = lambda at, n: F.when(F.col("size") >= at + n, F.array_join(F.slice(words, at + 1, n), " "))
    return F.array_distinct(F.filter(F.array(*(F.when(F.col("size") > n, run(at, n)) for n in range(2, max_n) for at in range(max_n - n + 1))), lambda x: x.isNotNull()))


def collocations(docs: DataFrame, max_n: int = 3, min_count: int = 10, inside_percent: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases of 2 to ``max_n`` words.

    a is the phrase's count; cut where the score is lowest, l and r are the counts of its parts; score is the floor of
    1000000 * a * a / (l * r). A phrase within a longer one that has ``inside_percent`` of its count or more does not count.
    """
    counts, totals = phrase_counts(docs, max_n, min_count, lang_col, text_col)
    found = counts.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    cut = lambda k: F.when(F.col("size") > k, F.struct(F.lit(k).alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("left"), F.array_join(F.slice(words, k + 1, max_n), " ").alias("right")))
    cuts = found.select("lang", "phrase", "a", F.inline(F.filter(F.array(*map(cut, range(1, max_n))), lambda x: x.isNotNull())))
    part = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    parted = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("(cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) * 1000000) div (cast(l as decimal(15, 0)) * cast(r as decimal(15, 0)))")
    lowest = parted.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longest = counts.filter("size > 2").select("lang", F.explode(_subphrases(max_n)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = lowest.join(longest, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a"))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    best = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)  # of SPREAD * top rows
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
