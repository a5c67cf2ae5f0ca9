"""Vectorised text kernels for Arrow batches: byte buffers, words, hashes.

A batch of texts is one byte array with row offsets, so words of all rows are found and hashed together. Work is cut
into slices of bounded size; only a single row larger than a slice makes a larger one.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
#: bytes of text and rows of a portion, see ``portions``
PORTION_BYTES, PORTION_ROWS = 1 << 20, 1 << 11


def tidy(batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function, which gives freed memory back to the system when a task ends: workers wait for their next task with little."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from batches(frames)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
_rng = np.random.default_rng(20240229)
byte_codes = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ratio = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), applied to every element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and len + 1 offsets; a null row is empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    _, offsets, data = filled.buffers()
    if len(filled) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def lowered(column: pa.Array) -> pa.Array:
    """Texts in lower case, in all scripts; nulls as empty texts."""
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (i, j) of at most ``most`` bytes each, one row at least."""
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, rows)
        i = j


def portions(frames: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, in batches of at most ``PORTION_BYTES`` of text and ``PORTION_ROWS`` (one row at least).

    Spark hands over ten thousand rows at once; copies of the texts are made of a portion only, and results leave by portions.
    """
    for frame in frames:
        sizes = pc.fill_null(pc.binary_length(frame.column(column)), 0).to_numpy(zero_copy_only=False)
        for i, j in slices(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), PORTION_BYTES):
            for k in range(i, j, PORTION_ROWS):
                yield frame.slice(k, min(j - k, PORTION_ROWS))


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash ratio; the table grows with the longest word seen."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 2 * len(_powers)) - 1, _ratio, np.uint64)]))
    return _powers


_powers = np.ones(1, np.uint64)


def runs(data: np.ndarray, offsets: np.ndarray, inside_table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of bytes that the table marks, in all rows: (row, start byte relative to the first row, hash)."""
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(part) == 0:
        return none
    inside = inside_table[part]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1] - base
    firsts = firsts[firsts < len(part)]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    if len(starts) == 0:
        return none
    kept = np.flatnonzero(inside)
    first = np.searchsorted(kept, starts)
    lengths = np.diff(np.append(first, len(kept)))
    within = np.arange(len(kept)) - np.repeat(first, lengths)
    letters = part[kept]
    if lower:
        letters = _lower[letters]
    hashed = mix(np.add.reduceat(byte_codes[letters] * powers(int(lengths.max()) + 1)[within], first))
    return np.searchsorted(offsets - base, starts, "right") - 1, starts, hashed


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all rows, see ``runs``; A-Z are lower-cased for the hash unless ``lower`` is false."""
    return runs(data, offsets, ~_space, lower)


_weights = _rng.integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(rows: np.ndarray, hashed: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``size`` words inside a row; a row of fewer words gives its whole sequence once."""
    n = len(hashed)
    if n == 0:
        return rows, hashed
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    counts = np.diff(np.append(first, n))
    out_rows, out = [], []
    if n >= size:
        run = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            run += hashed[k : n - size + 1 + k] * _weights[k]
        whole = rows[: n - size + 1] == rows[size - 1 :]
        out_rows.append(rows[: n - size + 1][whole])
        out.append(mix(run[whole]))
    short = counts < size
    if short.any():
        for c in range(1, size):
            at = first[counts == c]
            if len(at):
                run = np.full(len(at), c, np.uint64) * _weights[size]
                for k in range(c):
                    run += hashed[at + k] * _weights[k]
                out_rows.append(rows[at])
                out.append(mix(run))
    return np.concatenate(out_rows), np.concatenate(out)


def sets(rows: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by both."""
    order = np.lexsort((hashed, rows))
    rows, hashed = rows[order], hashed[order]
    if len(rows) == 0:
        return rows, hashed
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (hashed[1:] != hashed[:-1])])
    return rows[new], hashed[new]


def list_array(flat: pa.Array | np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list column from its flat values and the length of each row."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = flat if isinstance(flat, pa.Array) else pa.array(flat)
    return pa.ListArray.from_arrays(pa.array(ends), values)
