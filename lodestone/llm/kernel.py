"""Vectorised word and shingle hashing over Arrow string batches.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.  A word's hash is a
polynomial over keyed byte values taken from prefix sums modulo 2**64, so a whole slice of texts is hashed
by a handful of numpy calls.  Hashes are the same in every process and run.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the scratch arrays at roughly 60 bytes for each.
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes that are no letter or digit of ASCII, nor part of another character.
_MARK = np.ones(256, bool)
_MARK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_AS_IS = _VALUE.copy()
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_COEF = mix(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        have = _powers[0] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have[0][:n], have[1][:n]


def tidy(run: Callable) -> Callable:
    """`run`, a function of Arrow batches, which at its end gives the memory that it has freed back to the system."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidied


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of rows of about `limit` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        width = np.int64
    else:
        texts, width = texts.cast(pa.string()), np.int32
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(raw: np.ndarray, off: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte) of every word of the rows, and the index of each row's first word (one more at the end).

    marks: words end at every ASCII character that is no letter or digit, not only at white space.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~(_MARK if marks else _SPACE)[raw]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end[:-1] &= ~inside[1:] | cut[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def hash_words(raw: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of every word; fold: A-Z count as a-z."""
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_VALUE if fold else _AS_IS)[raw] * up[: len(raw)], out=total[1:])
    return mix((total[e] - total[s]) * down[s])


def hash_grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k-word window within a row, and the index of each row's first one (one more at the end)."""
    count = np.maximum(np.diff(first) - (k - 1), 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], count)
    g = np.zeros(len(at), np.uint64)
    for j in range(k):
        g += h[at + j] * _COEF[j]
    return mix(g), begin


def hash_run(h: np.ndarray) -> np.uint64:
    """A hash of a whole sequence of words."""
    return mix((h * powers(len(h) + 1)[0][1:]).sum(keepdims=True) + np.uint64(len(h)))[0]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, sorted distinct shingle hashes, words) of every row; a row of fewer than k words has its whole sequence as one."""
    for a, _, raw, off in slices(texts):
        s, e, first = words(raw, off)
        h = hash_words(raw, s, e)
        g, begin = hash_grams(h, first, k)
        for i in range(len(off) - 1):
            n = int(first[i + 1] - first[i])
            if n >= k:
                x = g[begin[i] : begin[i + 1]].copy()
                x.sort()
                if len(x) > 1:
                    x = x[np.concatenate([[True], x[1:] != x[:-1]])]
                yield a + i, x, n
            else:
                yield a + i, (hash_run(h[first[i] : first[i + 1]])[None] if n else np.zeros(0, np.uint64)), n
