"""Vectorised words, word hashes and rolling hashes over Arrow string batches.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  A word's 64-bit
hash is a polynomial over the UTF-8 bytes, taken from one prefix sum for a
whole batch, so no Python object is made per word.  Texts are worked on in
slices of a few MB; a text longer than a slice is a slice of its own, and its
per-byte arrays are still made in blocks of BLOCK bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 20
SLICE = 2 << 20
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
#: Also splits words at ASCII punctuation.
PLAIN = _SEP.copy()
PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n + 1, base, U), np.full(n + 1, inverse, U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


class _Powers:
    """Powers of one odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.size = base, 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, BLOCK + 4096)
            self.up, self.down = _powers(self.base, self.size)
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BASE), _Powers(_STEP)
_TABLE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_TABLE_LOWER = _TABLE.copy()
_TABLE_LOWER[65:91] = _TABLE[97:123]


class Words:
    """The words of a slice of texts: doc (index in the slice), byte start and end, hash; and counts per text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool, separators: np.ndarray = _SEP) -> None:
        self.data, self.bounds = data, bounds
        n = len(data)
        inside = ~separators[data]
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            heads = bounds[:-1][bounds[:-1] < n]
            begins[heads] = inside[heads]
            tails = bounds[1:][bounds[1:] > bounds[0]] - 1
            ends[tails] = inside[tails]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(bounds[1:], self.start, side="right")
        self.count = np.bincount(self.doc, minlength=len(bounds) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.hash = self._hashes(_TABLE_LOWER if lower else _TABLE)

    def _hashes(self, table: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), U)
        i = 0
        while i < len(out):
            base = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, base + BLOCK, side="right")))
            size = int(self.end[j - 1] - base)
            up, down = _BYTES.get(size)
            sums = np.zeros(size + 1, U)
            np.cumsum(table[self.data[base : base + size]] * up[:size], dtype=U, out=sums[1:])
            s, e = self.start[i:j] - base, self.end[i:j] - base
            out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U)
            i = j
        return mix(out)

    def text(self, first: int, last: int) -> bytes:
        """The words from first up to last, joined by one space."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[first:last].tolist(), self.end[first:last].tolist()))


def slices(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, Words]]:
    """(index of the first text, Words) for slices of a string or binary array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return
    _, at, body = texts.buffers()
    bounds = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE, side="right")) - 1)
        j = min(j, len(texts))
        yield i, Words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], lower)
        i = j


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside one text, and the index of each run's first word."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, np.int64)
    up, down = _WORDS.get(len(w.hash))
    sums = np.zeros(len(w.hash) + 1, U)
    np.cumsum(w.hash * up[: len(w.hash)], dtype=U, out=sums[1:])
    value = mix((sums[size:] - sums[:-size]) * down[:n] + U(size))
    at = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :])
    return value[at], at


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of `size` words; a shorter text has its whole sequence as one."""
    value, at = windows(w, size)
    docs = w.doc[at]
    cut = np.searchsorted(docs, np.arange(len(w.count) + 1))
    out = []
    for d, n in enumerate(w.count.tolist()):
        if n >= size:
            out.append(np.unique(value[cut[d] : cut[d + 1]]))
        elif n:
            h, (up, _) = w.hash[w.first[d] : w.first[d + 1]], _WORDS.get(size)
            out.append(mix(np.array([int(np.sum(h * up[:n], dtype=U))], U) + U(n)))
        else:
            out.append(np.empty(0, U))
    return out


def give_back() -> None:
    """Return memory that is free to the system; workers wait for their next task for a while, and others need it meanwhile."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(run: Callable) -> Callable:
    """A function over the batches of a task that gives memory back at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def gathered(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches with about `size` bytes of the column, from smaller ones."""
    held, amount = [], 0
    for batch in batches:
        held.append(batch)
        amount += batch.column(column).nbytes
        if amount >= size:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else batch
            del batch
            held, amount = [], 0
            yield whole
            del whole
    if any(b.num_rows for b in held):
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
