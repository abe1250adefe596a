"""Whole texts to words and 64-bit word hashes, in numpy over a batch of UTF-8 bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, unchanged.  A hash depends on
the word's bytes only, so every executor gives equal words equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text hashed at once; a longer document is taken alone.
SLICE = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    first: int  # row of the batch that doc 0 is
    data: np.ndarray  # bytes
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    offset: np.ndarray  # of each document's first word; one more than documents
    hash: np.ndarray


def _hashed(data: np.ndarray, bounds: np.ndarray, first: int) -> Words:
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(first, data, z, z, np.zeros(len(bounds), np.int64), np.zeros(0, np.uint64))
    inside = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    begin = inside & (~before | cut[:n])
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = inside & (~after | cut[1:])
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    p, q = powers(n + 1)
    if n > 4 * SLICE:  # a very long document: its powers are not kept
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * p[:n], out=total[1:])
    h = mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64))
    return Words(first, data, start, end, np.searchsorted(start, bounds).astype(np.int64), h)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def batch_words(column: pa.Array, size: int = SLICE) -> Iterator[Words]:
    """The words of a batch, about ``size`` bytes of documents at a time."""
    data, offsets = text_bytes(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        j = min(j, n)
        yield _hashed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of ``n`` values; none if there are fewer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= U(BASE)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)
