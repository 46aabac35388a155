"""Arrow text columns as byte buffers, word bounds and rolling hashes in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser over uint64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for at least n positions."""
    if len(_powers[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base & _MASK, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` turns two of them into the hash of the bytes between."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end): depends on the bytes and their number only."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def trimmed(run: Callable) -> Callable:
    """``run`` over record batches, after which the worker gives its freed memory back, as it lives on beside those of other stages."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` bytes together; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-white bytes; a row's end ends a word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~WHITE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, ink[:-1]
    after[-1], after[:-1] = False, ink[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, words before each row). ``data`` as from ``buffers``."""
    data = LOWER[data]
    start, end = word_bounds(data, offsets)
    return span_hash(prefix_hash(data), start, end), np.searchsorted(start, offsets)


def sequences(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k words in a row of each document, and sequences before each document.

    A document with fewer words, but at least one, gives its whole sequence as one.
    """
    counts = np.diff(firsts)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_firsts = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(firsts[:-1], n) + (np.arange(out_firsts[-1]) - np.repeat(out_firsts[:-1], n))
    size = np.minimum(np.repeat(counts, n), k)
    h = mix(size.astype(np.uint64))
    for j in range(k):
        live = size > j
        word = words[np.minimum(at + j, len(words) - 1)] if len(words) else at.astype(np.uint64)
        h = np.where(live, mix(h * np.uint64(0x9E3779B97F4A7C15) + word), h)
    return h, out_firsts


class HashIndex:
    """Sorted uint64 keys behind a directory of their leading bits; rows of values stand in the same order."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, min(26, int(max(1, len(keys))).bit_length()))
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.directory = np.append(np.searchsorted(keys, edges), len(keys)).astype(np.int64)

    def find(self, q: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is absent."""
        out = np.full(len(q), -1, np.int64)
        bucket = (q >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.directory[bucket], self.directory[bucket + 1]
        live = np.flatnonzero(at < stop)
        at, stop, q = at[live], stop[live], q[live]
        while len(live):
            key = self.keys[at]
            hit = key == q
            out[live[hit]] = at[hit]
            go = (key < q) & (at + 1 < stop)
            live, at, stop, q = live[go], at[go] + 1, stop[go], q[go]
        return out
