"""Content-defined anchors: which places of a text any long repeat must share.

Each string of ``length`` bytes (a window) is represented by the ``gram`` bytes in it whose hash is smallest (the last of
equals): its anchor. Equal windows have equal anchors at the same distance, so windows need comparing only within the
occurrences of one anchor. The windows that an occurrence represents are consecutive; together they are its context.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from corpuslab.llm import kernels as K

#: Bytes of one document that are hashed at a time (plus one window).
PIECE = 1 << 22
_INDEX = np.uint64((1 << 24) - 1)


class Anchors(NamedTuple):
    row: np.ndarray  # row number in the slice
    place: np.ndarray  # byte of the anchor, from the start of the row
    first: np.ndarray  # first and last window start that it represents
    last: np.ndarray
    anchor: np.ndarray  # hash of the anchor (int64)
    context: np.ndarray  # hash of the context and of the anchor's place in it (int64)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` keys."""
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    rest = width - span
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def _of_piece(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    n = len(data)
    up, down = K.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(K._BYTE_CODE[data] * up[:n], out=sums[1:])
    hashes = K.mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    index = np.arange(len(hashes), dtype=np.uint64)
    best = _least((hashes & ~_INDEX) | (_INDEX - index), length - gram + 1)
    at = (_INDEX - (best & _INDEX)).astype(np.int64)
    # Windows that cross rows are no windows.
    sizes = np.diff(offsets)
    whole = np.zeros(n + 1, np.int8)
    long_rows = np.flatnonzero(sizes >= length)
    whole[offsets[long_rows]] += 1
    whole[offsets[long_rows + 1] - length + 1] -= 1
    inside = np.cumsum(whole[: len(at)]) > 0
    start = np.flatnonzero(inside)
    if not len(start):
        return (np.zeros(0, np.int64),) * 6
    at = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    first = start[new]
    last = start[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
    place = at[new]
    span = (sums[last + length] - sums[first]) * down[first]
    context = K.mix(K.mix(span) + (place - first).astype(np.uint64) * np.uint64(1_000_003) + (last - first).astype(np.uint64))
    row = np.searchsorted(offsets, first, side="right") - 1
    return row, place, first, last, hashes[place].view(np.int64), context.view(np.int64)


def find_anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Anchors:
    """Anchors of all rows of a slice; rows shorter than ``length`` have none. A long row is hashed piece by piece; a
    context cut by a piece's end counts as two."""
    parts: list[tuple[np.ndarray, ...]] = []
    for first, last, begin, end in _pieces(offsets, length):
        own = np.clip(offsets[first : last + 1], begin, end)
        row, place, lo, hi, anchor, context = _of_piece(data[own[0] : own[-1]], own - own[0], length, gram) if own[-1] - own[0] >= length else (np.zeros(0, np.int64),) * 6
        base = own[0] - offsets[first + row] if len(row) else row
        parts.append((row + first, place + base, lo + base, hi + base, anchor, context))
    return Anchors(*(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(6)))


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    for first, last in K.slices(offsets, PIECE):
        begin, end = int(offsets[first]), int(offsets[last])
        if end - begin <= PIECE:
            yield first, last, begin, end
            continue
        for at in range(begin, max(begin + 1, end - length + 1), PIECE):
            yield first, last, at, min(end, at + PIECE + length - 1)
