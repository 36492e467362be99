"""External-memory building blocks of one task: vectors, sorts and queues that spill to scratch files."""

from __future__ import annotations

import os
import tempfile
from collections import deque
from collections.abc import Iterator
from typing import IO

import numpy as np

#: Bytes that are read of a scratch file at a time.
BLOCK = 1 << 20


def scratch() -> IO[bytes]:
    """A file without a name in Spark's local folders of this executor; it vanishes with the task."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)


class Vector:
    """Numbers of one kind that grow at the end; beyond ``limit`` bytes they are in a scratch file."""

    def __init__(self, kind: type | np.dtype, limit: int) -> None:
        self.kind, self.limit, self.n = np.dtype(kind), limit, 0
        self._parts: list[np.ndarray] = []
        self._file: IO[bytes] | None = None

    def __len__(self) -> int:
        return self.n

    def append(self, values: np.ndarray) -> None:
        values = np.ascontiguousarray(values, self.kind)
        if self._file is None and (self.n + len(values)) * self.kind.itemsize > self.limit:
            self._file = scratch()
            for part in self._parts:
                self._file.write(part.data)
            self._parts = []
        if self._file is None:
            self._parts.append(values)
        elif len(values):
            self._file.write(values.data)
        self.n += len(values)

    def _whole(self) -> np.ndarray:
        if len(self._parts) != 1:
            self._parts = [np.concatenate(self._parts) if self._parts else np.zeros(0, self.kind)]
        return self._parts[0]

    def read(self, first: int, last: int) -> np.ndarray:
        first, last = max(0, first), min(self.n, last)
        if self._file is None:
            return self._whole()[first:last]
        self._file.flush()
        size = self.kind.itemsize
        return np.frombuffer(os.pread(self._file.fileno(), (last - first) * size, first * size), self.kind)

    def take(self, at: np.ndarray) -> np.ndarray:
        """Values at many places; of a file only the blocks with such places are read, in order."""
        return self._whole()[at] if self._file is None else self.windows(at, 1)[:, 0]

    def windows(self, at: np.ndarray, width: int) -> np.ndarray:
        """``width`` values from each place on, zeros beyond the end."""
        if self._file is None and self.n >= width:
            view = np.lib.stride_tricks.sliding_window_view(self._whole(), width)
            late = at > self.n - width
            out = view[np.where(late, 0, at)]
            for k in np.flatnonzero(late):
                own = self._whole()[at[k] :]
                out[k] = 0
                out[k, : len(own)] = own
            return out
        out = np.zeros((len(at), width), self.kind)
        if not len(at):
            return out
        order = np.argsort(at, kind="stable")
        own, size = at[order], BLOCK // self.kind.itemsize
        number = own // size
        cuts = np.flatnonzero(np.diff(number, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(own)), strict=True):
            begin = int(number[a]) * size
            data = np.zeros(size + width - 1, self.kind)
            got = self.read(begin, begin + size + width - 1)
            data[: len(got)] = got
            out[order[a:b]] = np.lib.stride_tricks.sliding_window_view(data, width)[own[a:b] - begin]
        return out


class Sorter:
    """Rows of columns, sorted by the first ``keys`` of them; beyond ``memory`` bytes as runs on disk that are merged."""

    def __init__(self, kinds: list[type], keys: int, memory: int) -> None:
        self.kinds, self.keys, self.memory = [np.dtype(k) for k in kinds], keys, memory
        self._rows: list[list[np.ndarray]] = []
        self._held = 0
        self._runs: list[list[Vector]] = []

    def add(self, *columns: np.ndarray) -> None:
        row = [np.asarray(c, k) for c, k in zip(columns, self.kinds, strict=True)]
        self._rows.append(row)
        self._held += sum(c.nbytes for c in row)
        if self._held > self.memory:
            self._close()

    def _in_order(self, parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(self.kinds)]
        order = np.lexsort(columns[: self.keys][::-1])
        return [c[order] for c in columns]

    def _close(self) -> None:
        run = [Vector(kind, 0) for kind in self.kinds]
        for vector, column in zip(run, self._in_order(self._rows), strict=True):
            vector.append(column)
        self._runs.append(run)
        self._rows, self._held = [], 0

    def _upto(self, columns: list[np.ndarray], bound: tuple) -> int:
        low, high = 0, len(columns[0])
        for column, value in zip(columns, bound, strict=False):
            low, high = low + np.searchsorted(column[low:high], value, "left"), low + np.searchsorted(column[low:high], value, "right")
        return int(high)

    def read(self, rows: int) -> Iterator[list[np.ndarray]]:
        """The sorted rows, some ``rows`` at a time."""
        if not self._runs:
            columns = self._in_order(self._rows)
            self._rows = []
            for a in range(0, len(columns[0]), rows):
                yield [c[a : a + rows] for c in columns]
            return
        if self._rows:
            self._close()
        each, total = max(64, rows // len(self._runs)), [len(run[0]) for run in self._runs]
        at = [min(each, n) for n in total]
        held = [[v.read(0, each) for v in run] for run in self._runs]
        while any(len(h[0]) for h in held):
            bounds = [tuple(c[-1] for c in h[: self.keys]) for h, a, n in zip(held, at, total, strict=True) if a < n]
            counts = [self._upto(h, min(bounds)) if bounds else len(h[0]) for h in held]
            yield self._in_order([[c[:k] for c in h] for h, k in zip(held, counts, strict=True) if k])
            for i, k in enumerate(counts):
                held[i] = [c[k:] for c in held[i]]
                if not len(held[i][0]) and at[i] < total[i]:
                    held[i] = [v.read(at[i], at[i] + each) for v in self._runs[i]]
                    at[i] = min(at[i] + each, total[i])


class Queues:
    """First-in-first-out queues of rows by group; beyond ``memory`` bytes new rows go to a scratch file."""

    def __init__(self, memory: int) -> None:
        self.memory, self.held, self.file, self.end = memory, 0, None, 0
        self.pieces: dict[int, deque] = {}

    def push(self, group: int, tag: int, *columns: np.ndarray) -> None:
        size = sum(c.nbytes for c in columns)
        if self.held + size <= self.memory:
            self.held += size
            piece = (tag, None, [c.copy() for c in columns])  # a slice would keep its whole batch
        else:
            self.file = self.file or scratch()
            for c in columns:
                self.file.write(np.ascontiguousarray(c).data)
            piece = (tag, self.end, [(len(c), c.dtype) for c in columns])
            self.end += size
        self.pieces.setdefault(group, deque()).append(piece)

    def pop(self, group: int, rows: int) -> tuple[np.ndarray, list[np.ndarray]] | None:
        """The tags and columns of the first pieces of a group, some ``rows`` of them; None if nothing waits."""
        waiting = self.pieces.get(group)
        if not waiting:
            return None
        tags, parts, n = [], [], 0
        while waiting and n < rows:
            tag, at, columns = waiting.popleft()
            if at is None:
                self.held -= sum(c.nbytes for c in columns)
            else:
                self.file.flush()
                read = []
                for size, kind in columns:
                    read.append(np.frombuffer(os.pread(self.file.fileno(), size * kind.itemsize, at), kind))
                    at += size * kind.itemsize
                columns = read
            tags.append(np.full(len(columns[0]), tag, np.int32))
            parts.append(columns)
            n += len(columns[0])
        if not waiting:
            del self.pieces[group]
        if len(parts) == 1:
            return tags[0], parts[0]
        return np.concatenate(tags), [np.concatenate([p[k] for p in parts]) for k in range(len(parts[0]))]
