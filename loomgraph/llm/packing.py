"""Packing token pieces into sequences of a fixed length: a configuration linear program.

Texts are tokenised in parallel; documents longer than a sequence are cut. Only the
histogram of piece lengths (at most ``capacity`` rows, whatever the number of documents)
comes to the driver. There the covering program over configurations (multisets of lengths
that fit a sequence) is solved by multiplicative weights: each round prices the lengths,
an exact unbounded-knapsack dynamic program finds the configurations of highest price,
they are taken a fraction at a time, and covered lengths lose weight. Copies are rounded
down; the lengths that rounding leaves are packed best-fit, longest first, into the room
that is left and into new sequences, on counts rather than on pieces.

Every piece then finds its place by rank among the pieces of its length. Ranks come from
counts per (length, task) and prefix sums over the tasks, so that a length that a third of
all pieces share is never one task's work. The prefix sums have a row for each length and
task, which grows with the data, so they meet the pieces in a shuffled join, by the keys that
ranking has dealt the pieces by already. The plan that is broadcast holds one entry per
slot of a configuration; its size depends on capacity and rounds, not on the data.

Defined results: null text counts as empty and gives the end id alone; repeated rows are
packed each for itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, trimmed, two_columns
from .encode import encoded, forget

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32())])
PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, task int"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the task that made the row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for batch in trimmed(batches):
            keys = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for row, ids in encoded(batch.column(1), tokenizer, end_id):
                raw = ids.astype("<u4")
                for p, s in enumerate(range(0, len(raw), capacity)):
                    part = raw[s : s + capacity]
                    rows.append((keys[row], p, s, len(part), zlib.crc32(part.tobytes()), task))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)
        forget()

    return two_columns(docs, id_col, text_col).mapInArrow(work, PIECES_SQL)


def knapsack(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over lengths 1..capacity (values[l]; 0 where absent): best value for each room, and the
    length taken last (0: none, leave one token of room)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(values > 0)
    worth = values[lengths]
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            total = best[c - lengths[:k]] + worth[:k]
            j = int(total.argmax())
            if total[j] > best[c]:
                best[c], last[c] = total[j], lengths[j]
    return best, last


def configuration(last: np.ndarray, room: int) -> dict[int, int]:
    taken: dict[int, int] = {}
    while room > 0:
        if n := int(last[room]):
            taken[n] = taken.get(n, 0) + 1
            room -= n
        else:
            room -= 1
    return taken


def solve(counts: np.ndarray, capacity: int, rounds: int = 60, rate: float = 3.0, share: float = 0.3, slack: float = 0.05) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how often each is used; together they hold exactly ``counts[l]`` pieces of each length l.

    Multiplicative weights on the covering program: a length starts at the price of its share of a sequence, and half
    a sequence more where no second of its kind fits; what is covered lowers the price by ``exp(-rate * covered share)``.
    One dynamic program gives, for every length, the dearest configuration that holds it; those within ``slack`` of the
    dearest of all are taken, least covered length first, until the round has covered ``share`` of a length.
    """
    counts = counts.astype(np.int64)
    live = np.flatnonzero(counts[:capacity] > 0)  # full pieces are configurations of their own
    start = live / capacity + 0.5 * (live > capacity / 2)
    covered = np.zeros(capacity + 1)
    taken: dict[tuple[tuple[int, int], ...], float] = {}
    for _ in range(rounds if len(live) else 0):
        prices = np.zeros(capacity + 1)
        prices[live] = start * np.exp(-rate * covered[live])
        best, last = knapsack(prices, capacity)
        good = live[prices[live] + best[capacity - live] >= (1 - slack) * best[capacity]]
        use = np.zeros(capacity + 1)
        for n in good[np.argsort(covered[good], kind="stable")].tolist():
            if use[n] >= share:
                continue
            column = configuration(last, capacity - n)
            column[n] = column.get(n, 0) + 1
            copies = min((share - use[m]) * counts[m] / k for m, k in column.items())
            if copies > 0:
                key = tuple(sorted(column.items(), reverse=True))
                taken[key] = taken.get(key, 0.0) + copies
                for m, k in key:
                    use[m] += copies * k / counts[m]
        covered += use
        if covered[live].min() >= 1:
            break
    scale = max(1.0, covered[live].min()) if len(live) else 1.0
    left = counts.copy()
    left[capacity] = 0
    groups: list[list] = [[0, [capacity], int(counts[capacity])]] if counts[capacity] else []  # [room, lengths, copies]
    for key, x in sorted(taken.items(), reverse=True):
        todo = int(x / scale + 1e-9)
        while todo and (fit := [(n, min(k, int(left[n]))) for n, k in key if left[n]]):  # a length that has run out leaves room
            copies = min([todo, *(int(left[n] // k) for n, k in fit)])
            lengths = [n for n, k in fit for _ in range(k)]
            groups.append([capacity - sum(lengths), lengths, copies])
            for n, k in fit:
                left[n] -= copies * k
            todo -= copies
    return best_fit(left, groups, capacity)


def best_fit(left: np.ndarray, groups: list[list], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest sequence with room; equal sequences move together as one group."""
    by_room: list[list[list]] = [[] for _ in range(capacity + 1)]
    for g in groups:
        by_room[g[0]].append(g)
    rooms = np.array([len(x) for x in by_room])
    for n in range(capacity, 0, -1):
        todo = int(left[n])
        while todo:
            fits = np.flatnonzero(rooms[n:])
            if not len(fits):
                k = min(capacity // n, todo)
                new, copies = [n] * k, todo // k
                by_room[capacity - n * k].append([capacity - n * k, new, copies])
                rooms[capacity - n * k] += 1
                todo -= k * copies
                continue
            room = n + int(fits[0])
            g = by_room[room].pop()
            rooms[room] -= 1
            k = min(room // n, todo)
            copies = min(g[2], todo // k)
            if g[2] > copies:
                by_room[room].append([room, g[1], g[2] - copies])
                rooms[room] += 1
            by_room[room - n * k].append([room - n * k, g[1] + [n] * k, copies])
            rooms[room - n * k] += 1
            todo -= k * copies
    return [(tuple(g[1]), g[2]) for at in by_room for g in at]


def slots(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys ``length << 40 | first rank``, and for each the sequence of that rank and the offset in it."""
    used = np.zeros(capacity + 1, np.int64)
    key, sequence, offset, base = [], [], [], 0
    for lengths, copies in plan:
        at = 0
        for n in lengths:
            key.append((n << 40) + int(used[n]))
            sequence.append(base)
            offset.append(at)
            used[n] += copies
            at += n
        base += copies
    key_, order = np.array(key, np.int64), np.argsort(np.array(key, np.int64))
    return key_[order], np.array(sequence, np.int64)[order], np.array(offset, np.int64)[order]


def packed(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row per piece."""
    pieces = materialise(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    per_task = materialise(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[row["length"]] = row["n"]
    plan = docs.sparkSession.sparkContext.broadcast(slots(solve(counts, capacity), capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = plan.value
        for batch in trimmed(batches):
            if not batch.num_rows:
                continue
            want = (batch.column("length").to_numpy() << 40) + batch.column("rank").to_numpy()
            slot = np.searchsorted(keys, want, side="right") - 1
            columns = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequences[slot] + want - keys[slot]), pa.array(offsets[slot])], names=[*PIECES.names[:5], "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.withColumn("nth", F.row_number().over(Window.partitionBy("length", "task").orderBy("doc_id", "piece")))
    ranked = ranked.join(bases.hint("merge"), ["length", "task"]).select(*PIECES.names[:5], (F.col("base") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
