"""Whole texts to token ids with the tokenizers library, paying for each distinct word once.

A text is cut before every single space that stands between two visible characters, around
every line break of that kind, and between an ASCII letter and ASCII punctuation other than
an apostrophe. Both vocabularies in use start a new pre-token there (one glues the space to
the word that follows, the other drops it), so the ids of a text are the ids of its pieces
in a row; a test holds this against encoding whole texts. Each piece is looked up in a bounded
per-task cache and goes through the library only when it is new. The tokenizer and its cache
go at the end of a task (``forget``): Python workers live on, and other stages need their memory.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from .common import release, span_hashes, text_chunks

#: Pieces kept per task before the cache starts anew.
CACHE_PIECES = 400_000
VISIBLE, LATIN, SPACE, BREAK, LETTER, PUNCTUATION = 1, 2, 4, 8, 16, 32
_byte = np.arange(256)
_letter = (_byte >= 65) & (_byte <= 90) | (_byte >= 97) & (_byte <= 122)
_digit = (_byte >= 48) & (_byte <= 57)
_visible = (_byte > 0x20) & (_byte < 0x7F)
#: What a byte is. LATIN: first byte of a two-byte character from U+00C0 to U+02BF; no white space lies there.
KINDS = (
    VISIBLE * _visible + LATIN * ((_byte >= 0xC3) & (_byte <= 0xCA)) + SPACE * (_byte == 0x20) + BREAK * (_byte == 0x0A) + LETTER * _letter + PUNCTUATION * (_visible & ~_letter & ~_digit & (_byte != 0x27))
).astype(np.uint8)
_encoders: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)  # sorted
        self.first = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self.clear()
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for e in ids for x in e), np.int32, int(count.sum()))
        first = np.cumsum(count) - count + len(self.pool)
        self.pool = np.concatenate([self.pool, flat])
        order = np.argsort(keys)
        keys = keys[order]
        slot = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, slot, keys)
        self.first = np.insert(self.first, slot, first[order])
        self.count = np.insert(self.count, slot, count[order])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin (one entry more than texts)."""
        n = len(data)
        if not n:
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(n + 1, dtype=bool)
        if n > 3:
            kind = KINDS[data]
            after = (kind & VISIBLE | kind & LATIN) > 0
            before = (kind & VISIBLE) > 0
            before[1:] |= (kind[:-1] & LATIN) > 0
            single = (kind[1:-1] & (SPACE | BREAK) > 0) & before[:-2] & after[2:]
            cut[1 : n - 1] = single
            cut[2:n] |= single & (data[1:-1] == 0x0A)
            cut[1:n] |= (kind[1:] & PUNCTUATION > 0) & (kind[:-1] & LETTER > 0)
        cut[offsets] = True
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n)
        inverse, uniq = pd.factorize(span_hashes(data, starts, ends, False))
        at = np.empty(len(uniq), np.int64)
        at[inverse[::-1]] = np.arange(len(inverse) - 1, -1, -1)  # the first of each
        slot = np.searchsorted(self.keys, uniq)
        known = slot < len(self.keys)
        known[known] = self.keys[slot[known]] == uniq[known]
        if not known.all():
            raw = data.tobytes()
            pick = lambda which: [raw[a:b].decode("utf-8") for a, b in zip(starts[at[which]], ends[at[which]], strict=True)]
            size = len(self.keys)
            self.learn(uniq[~known], pick(~known))
            if len(self.keys) < size + int((~known).sum()):  # the cache started anew
                self.learn(uniq[known], pick(known))
            slot = np.searchsorted(self.keys, uniq)
        count, first = self.count[slot][inverse], self.first[slot][inverse]
        ends_at = np.cumsum(count)
        begin = ends_at - count
        ids = self.pool[np.repeat(first - begin, count) + np.arange(int(ends_at[-1]))]
        return ids, np.append(begin, ends_at[-1])[np.searchsorted(starts, offsets)]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    _encoders.clear()
    release()


def encoded(column: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids with ``end_id`` after them) for every text of a string column without nulls."""
    enc = encoder(path)
    for i, _, data, offsets in text_chunks(column):
        ids, bounds = enc.encode(data, offsets)
        ids = ids.astype(np.uint32)
        end = np.array([end_id], np.uint32)
        for k in range(len(offsets) - 1):
            yield i + k, np.concatenate([ids[bounds[k] : bounds[k + 1]], end])
