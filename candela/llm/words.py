"""Vectorised word and shingle hashing over Arrow batches of UTF-8 text.

A word is a maximal run of bytes other than space and 0x09-0x0D, which is the same
thing as ``[^\\x20\\x09-\\x0D]+`` on the decoded text. All functions work on a *chunk*: the
concatenated bytes of several documents plus their offsets. Chunks are cut at about
``CHUNK_BYTES`` so that working memory stays bounded however large the Arrow batch is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_R = 0x9E3779B97F4A7C15 | 1
_K = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary Arrow column; null counts as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, local offsets) for runs of rows of about ``limit`` bytes."""
    raw, off = text_buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray, in_word: np.ndarray = ~IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the index of its first word (n+1). ``in_word``: which bytes are part of one."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = in_word[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, solid[:-1]
    before[off[:-1][off[:-1] < len(data)]] = False
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, solid[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    step = np.full(int(size.max()), _R, np.uint64)
    step[0] = 1
    power = np.cumprod(step, dtype=np.uint64)
    first = np.cumsum(size) - size
    inside = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    value = (data[np.repeat(starts, size) + inside].astype(np.uint64) + np.uint64(1)) * power[inside]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive entries of ``h``; empty if there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out + h[k : k + n] * _K[k % 3] + np.uint64(k + 1))
    return out


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its ``width``-word shingles.

    Fewer words than ``width`` make one shingle of the whole sequence; no words, an empty set.
    """
    starts, ends, first = word_spans(data, off)
    h = word_hashes(data, starts, ends)
    every = window_hashes(h, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(every[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix(window_hashes(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
