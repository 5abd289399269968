"""Vectorised tokenising and hashing of whole texts held in Arrow string columns.

Words are the runs ``[^\\x20\\x09-\\x0D]+``; all separators are ASCII, so the work is done on UTF-8 bytes. A word's hash is a
64-bit polynomial over its bytes with a finishing mix; the hash of a run of words is a polynomial over the words' hashes.
Memory is a small multiple of ``CHUNK`` bytes, or of the longest single text where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
U = np.uint64
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n (kept, and grown by doubling)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 2**64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        have = _powers[base] = (made[0], made[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing mix: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Words:
    """The words of consecutive texts: byte bounds in ``data``, the text each belongs to, ``first[i]:first[i+1]`` of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row: int, lower: bool = False, separator: np.ndarray = SEPARATOR):
        self.data = LOWER[data] if lower else data
        self.offsets, self.row, self.n_docs = offsets, row, len(offsets) - 1
        inside = ~separator[self.data]
        n = len(inside)
        start, last = inside.copy(), inside.copy()
        if n:
            start[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            # a text's first and last byte bound its words, whatever stands in the next text
            full = offsets[1:] > offsets[:-1]
            a, z = offsets[:-1][full], offsets[1:][full] - 1
            start[a] |= inside[a]
            last[z] |= inside[z]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._hash = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hash(self.data, self.start, self.end)
        return self._hash

    def prefix(self) -> np.ndarray:
        """For ``run_hash``: the polynomial over the hashes of the words before each word."""
        p = np.zeros(len(self) + 1, np.uint64)
        np.cumsum(self.hash * powers(_WORD_BASE, max(1, len(self)))[0][: len(self)], out=p[1:])
        return p


def run_hash(prefix: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words [a, z), equal for equal runs wherever they stand."""
    return mix((prefix[z] - prefix[a]) * powers(_WORD_BASE, len(prefix))[1][a] + (z - a).astype(np.uint64))


def span_hash(data: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [a, z)."""
    up, down = powers(_BASE, len(data) + 1)
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=p[1:])
    return mix((p[z] - p[a]) * down[a])


def chunks(column: pa.Array, lower: bool = False, separator: np.ndarray = SEPARATOR) -> Iterator[Words]:
    """The texts of a column, some at a time; null counts as empty. ``row`` is the first text's place in the column."""
    for data, offsets, row in raw_chunks(column):
        yield Words(data, offsets, row, lower, separator)


def raw_chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        j = min(j, n)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i
        i = j


def per_doc_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over first[i]:first[i+1] for each i, empty ranges 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def doc_sum(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Float sums by text, each independent of what stands in other texts."""
    return np.bincount(doc, weights=values, minlength=n).astype(float)
