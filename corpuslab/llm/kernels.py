"""Vectorised byte-level text kernels shared by the operators of this subpackage.

Everything works on slices of an Arrow string column: one contiguous ``uint8`` buffer and the row offsets.
All delimiters used by the operators are ASCII, so UTF-8 text can be cut on bytes without decoding it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a single longer row is handled on its own.
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GOLDEN = np.uint64(0xD6E8FEB86659FD93)


def word_table(delimiters: list[tuple[int, int]]) -> np.ndarray:
    """``table[byte]`` is True for a byte of a word; delimiters are inclusive byte ranges."""
    table = np.ones(256, dtype=bool)
    for first, last in delimiters:
        table[first : last + 1] = False
    return table


#: Words ``[^\x20\x09-\x0D]+`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (the latter after lower-casing A-Z).
SPACE_WORDS = word_table([(0x20, 0x20), (0x09, 0x0D)])
ALNUM_WORDS = word_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_CODE_LOWER = _BYTE_CODE[LOWER]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _GOLDEN
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, starting at 0) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, and one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


class Words:
    """Words of the rows of one slice: byte ranges, row numbers and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True) -> None:
        n = len(data)
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        inside = table[data] if n else np.zeros(0, bool)
        begins = np.zeros(n + 1, bool)
        begins[offsets[:-1]] = True
        first = inside.copy()
        if n:
            first[1:] &= ~inside[:-1] | begins[1:n]
        last = inside.copy()
        if n:
            last[:-1] &= ~inside[1:] | begins[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)  # word range of each row
        self.count = np.diff(self.bounds)
        self.hash = np.zeros(0, np.uint64)
        if hashed and len(self.start):
            up, down = powers(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE_CODE_LOWER[data] * up[:n], out=sums[1:])
            self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def sequence_hash(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes (the caller drops runs that cross rows)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out = mix(out * _BASE + words[k : k + n])
    return out


def whole_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence, equal to :func:`sequence_hash` of that width."""
    return sequence_hash(words, len(words))[0]
