"""Hashes of words and word windows, for whole Arrow batches of texts at once.

The bytes of many texts lie in one buffer.  A running polynomial modulo 2^64 over all bytes
gives every word's hash as a difference of two entries, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in pieces of about this many bytes, to bound memory; a longer text is one piece.
PIECE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(salt: int) -> np.ndarray:
    return mix(np.arange(1 + salt * 256, 257 + salt * 256, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


class Pieces:
    """Word hashes of the texts of a piece: ``first[i]`` to ``first[i + 1]`` are the words of text i."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, rows: slice, fold: bool, salt: int):
        self.rows, self.data = rows, data
        raw = _LOWER[data] if fold else data
        space = _SPACE[data]
        # texts end at ``ends``; a word never runs over such an end
        starts_at = np.concatenate([[0], ends[:-1]])
        solid = ~space
        begin = solid.copy()
        begin[1:] &= space[:-1]
        inner = starts_at[starts_at < len(data)]
        begin[inner] = solid[inner]
        finish = solid.copy()
        finish[:-1] &= space[1:]
        last = ends[(ends > 0) & (ends <= len(data))] - 1
        finish[last] = solid[last]
        self.begin, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.begin, np.concatenate([starts_at, ends[-1:]]) if len(ends) else np.zeros(1, np.int64))
        power = np.full(len(data) + 1, np.uint64(_BASE), np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        back = np.full(len(data) + 1, np.uint64(pow(_BASE, -1, 1 << 64)), np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_values(salt)[raw] * power[:-1], dtype=np.uint64)])
        self.words = mix((total[self.end] - total[self.begin]) * back[self.begin] + (self.end - self.begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def pieces(text: pa.Array, fold: bool = False, salt: int = 0) -> Iterator[Pieces]:
    """``text`` (string; null counts as empty) in pieces of consecutive rows.  ``fold``: A-Z hash as a-z."""
    if text.null_count:
        text = text.fill_null("")
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1)
        to = min(to, len(text))
        yield Pieces(data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at], slice(at, to), fold, salt)
        at = to


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for every ``width`` consecutive entries of ``words`` (across texts too; the caller drops those)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(_BASE) + words[k : k + n])
    return out


def text_of(begin: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every word the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
