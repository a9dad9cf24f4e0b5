"""Token counts without tokens: a Viterbi pass that carries best score and piece count.

An Aho-Corasick automaton over the unigram vocabulary enumerates every piece that ends at
each position; the dynamic program keeps, per position, the best score so far and the
number of pieces on that path. Ties follow the tokenizer: candidates of one position come
longest first and only a strictly better score replaces; a character that is no piece by
itself may be an unknown piece (lowest score - 10), and neighbouring unknowns are one run,
which counts as the bytes that it falls back to (or as one, where the vocabulary has no bytes).

Any scored vocabulary is read as a unigram one. Where the model file holds a merge-rank (BPE)
model, the counts are those of the best path by its scores, not those of its own encoder,
and its normaliser is not applied.

Texts are cut into words the way the tokenizer's word-start marker does, so each distinct
word is scored once per process and then looked up; the cache is bounded.

Defined results: null and empty texts have 0 tokens; one row per input row; further
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import trimmed, two_columns

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 500_000
_counters: dict[str, UnigramCounter] = {}


def unigram_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) rows and the index of the unknown piece, from a sentencepiece model file.

    Scores are the model's own; control and user-defined pieces carry none and are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(model.id_to_piece(model.unk_id()), 0.0)]
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i)) and model.get_score(i) > -1e6:
            rows.append((model.id_to_piece(i), model.get_score(i)))
    return rows, 0


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unknown))
        self.automaton.make_automaton()
        self.singles = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.fallback = {f"<0x{b:02X}>" for b in range(256)} <= {piece for piece, _ in vocabulary}
        self.unknown_score = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def word(self, text: str) -> int:
        """Number of pieces of one word (marker included)."""
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)  # of the pieces before the run of unknowns that ends here
        run = [n + 1] * (n + 1)  # where that run begins; n + 1: there is none
        known = [True] * (n + 1)  # whether that run is the unknown piece's own text, once
        at = 0  # positions up to here are settled

        def upto(end: int) -> int:
            """Pieces of the best path to ``end``."""
            if run[end] > n:
                return count[end]
            return count[end] + (1 if known[end] or not self.fallback else len(text[run[end] : end].encode()))

        def unknown(start: int, end: int, score: float, literal: bool) -> None:
            first = run[start] > n
            best[end], count[end], run[end], known[end] = score, count[start], start if first else run[start], literal and first

        def settle(last: int) -> None:
            nonlocal at
            while at < last:
                at += 1
                if text[at - 1] not in self.singles:
                    score = best[at - 1] + self.unknown_score
                    if best[at] is None or score > best[at]:
                        unknown(at - 1, at, score, False)

        for last, (length, piece_score, is_unknown) in self.automaton.iter(text):
            end = last + 1
            if at < last:
                settle(last)
            start = end - length
            score = piece_score + best[start]
            if best[end] is None or score > best[end]:
                if is_unknown:
                    unknown(start, end, score, True)
                else:
                    best[end], count[end], run[end] = score, upto(start) + 1, n + 1
        settle(n)
        return upto(n)

    def text(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        parts = text.split(MARK)
        if text[0] == MARK:
            del parts[0]
        cache, total = self.cache, 0
        for part, times in Counter(parts).items():
            n = cache.get(part)
            if n is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                n = self.word(MARK + part)
                if len(part) < 64:
                    cache[part] = n
            total += n * times
        return total


def counter(path: str) -> UnigramCounter:
    if path not in _counters:
        _counters[path] = UnigramCounter(*unigram_vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens for every row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).text
        for batch in trimmed(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(x.as_py()) for x in batch.column(1)], pa.int64())], names=["doc_id", "n_tokens"])

    return two_columns(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_tokens long")
