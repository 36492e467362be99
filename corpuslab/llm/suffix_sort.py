"""External suffix sorting by induced sorting, with common-prefix values, in bounded memory.

The text is a row of pieces, each closed by the symbol 0; two closing symbols are never equal, so no common prefix
crosses a piece. A suffix is of type S if it is smaller than the one that begins a symbol later, else of type L; an S
after an L is a star. The stars are sorted first: the substrings from star to star are sorted externally and numbered in
their order, and unless all differ, the string of these names is sorted the same way, recursively, down to a string
whose work arrays fit into ``memory``. Two sorted neighbours share the names that the recursion found equal, and what
their next substrings have in common.

Then the order is induced: going up through the sorted stars and the L suffixes found so far, each suffix hands its
predecessor, if that is an L, to a queue; going down, likewise for the S suffixes. The queues are the priority queue of
the algorithm, keyed by first symbol and order of arrival, on disk beyond their share of ``memory``. A tuple holds its
position and the common prefix with the tuple before it, which is the minimum of the values passed since, plus one; where
two tuples come from different batches, the minima at the ends of both and over the batches between them give it. Bytes
have a queue each; names share queues by ranges that hold a batch, but for frequent names.

Text, stars, names and order are vectors that go to scratch files when they are large; places in a file are looked up in
order, block by block. So memory does not grow with the text, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np

from corpuslab.llm.external import Queues, Sorter, Vector

#: Bytes of work arrays for each name of a string that is ranked in memory, and for each row of a batch.
NAME_BYTES, ROW_BYTES = 96, 512
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


class Symbols(NamedTuple):
    """First symbol of each range of symbols that shares a queue, and whether the range is one symbol."""

    bounds: np.ndarray
    single: np.ndarray

    def group(self, symbols: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, symbols, "right") - 1


BYTES = Symbols(np.arange(256), np.ones(256, bool))


def batch_rows(memory: int) -> int:
    return max(8, memory // ROW_BYTES)


def range_minimum(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of ``values[first..last]`` (inclusive, not empty) for many ranges."""
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), values.dtype)
    table, span = values, 1
    for k in range(int(level.max(initial=-1)) + 1):
        pick = np.flatnonzero(level == k)
        if len(pick):
            out[pick] = np.minimum(table[first[pick]], table[last[pick] - span + 1])
        if k < level.max():
            table, span = np.minimum(table[:-span], table[span:]), span * 2
    return out


def common_prefix(text: Vector, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at ``a`` and ``b``, up to ``cap``; the symbol 0 equals nothing."""
    out, open_ones, done, step = np.zeros(len(a), np.int64), np.arange(len(a)), 0, 16 // text.kind.itemsize
    while len(open_ones) and done < cap:
        left, right = text.windows(a[open_ones] + done, step), text.windows(b[open_ones] + done, step)
        same = (left == right) & (left != 0)
        run = np.where(same.all(1), step, same.argmin(1))
        out[open_ones] += run
        open_ones = open_ones[run == step]
        done += step
    return np.minimum(out, cap)


def _types(block: np.ndarray, after: int, after_kind: bool) -> np.ndarray:
    """True for S, of a block before the symbol ``after``. Runs of one symbol take the type of their end; a closing symbol is an S."""
    following = np.append(block, block.dtype.type(after))
    ends = np.flatnonzero(following[1:] != following[:-1])
    kind = np.full(len(block), after_kind)
    kind[: ends[-1] + 1 if len(ends) else 0] = np.repeat(following[ends] < following[ends + 1], np.diff(ends, prepend=-1))
    kind[block == 0] = True
    return kind


def _stars(text: Vector, memory: int) -> Vector:
    """Places of the stars: types come from the end, places are listed from the beginning."""
    size = max(64, memory // 32)
    begins = range(0, len(text), size)
    after, kind, known = 0, True, []
    for a in reversed(begins):
        known.append((after, kind))
        block = text.read(a, a + size)
        kind = bool(_types(block, after, kind)[0])
        after = int(block[0])
    out, before = Vector(np.int64, memory // 8), True
    for a, state in zip(begins, reversed(known), strict=True):
        kinds = _types(text.read(a, a + size), *state)
        star = kinds.copy()
        star[1:] &= ~kinds[:-1]
        star[0] &= not before
        before = bool(kinds[-1])
        out.append(np.flatnonzero(star) + a)
    return out


def _keys(text: Vector, begin: np.ndarray, size: np.ndarray, done: int) -> np.ndarray:
    """The next 8 bytes (or 2 names) of each substring from ``done`` on as one number; beyond its end all bits are set."""
    if text.kind == np.uint8:
        key, wide, bits = text.windows(begin + done, 8).view(">u8")[:, 0].astype(np.uint64), 8, 8
    else:
        pair = text.windows(begin + done, 2).astype(np.uint64)
        key, wide, bits = pair[:, 0] << np.uint64(32) | pair[:, 1], 2, 32
    left = np.clip(size - done, 0, wide)
    if done == 0:
        left[key >> np.uint64(64 - bits) == 0] = 1  # closing symbols are told apart by place alone
    pad = np.where(left == 0, _TOP, (np.uint64(1) << (bits * (wide - np.maximum(left, 1))).astype(np.uint64)) - np.uint64(1))
    return key | pad


def _closed(key: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Whether a key holds a closing symbol."""
    if kind == np.uint8:
        return (key - np.uint64(0x0101010101010101)) & ~key & np.uint64(0x8080808080808080) != 0
    return (key >> np.uint64(32) == 0) | (key & np.uint64(0xFFFFFFFF) == 0)


def _ranks(text: Vector, stars: Vector, memory: int) -> tuple[Sorter, bool, list[int]]:
    """(star number, rank) of the substrings from star to star, a sort by star number; whether any are equal; and ranks with more than a batch.

    The rank is the number of smaller substrings. One that is a prefix of another is the larger one, and those that touch
    a closing symbol differ by place."""
    rows, share = batch_rows(memory), memory // 6
    wide, ended = (8, np.uint64(255)) if text.kind == np.uint8 else (2, np.uint64(0xFFFFFFFF))
    final, equal, frequent = Sorter([np.int64, np.int64], 1, share), False, []
    number = range(0, len(stars), rows)
    active: Iterable[tuple[np.ndarray, np.ndarray]] = ((np.arange(a, min(a + rows, len(stars))), np.zeros(min(rows, len(stars) - a), np.int64)) for a in number)
    done, some = 0, True
    while some:
        some, tied = False, Sorter([np.int64, np.uint64, np.int64], 3, share)
        for k, rank in active:
            begin = stars.take(k)
            end = np.full(len(k), len(text) - 1)
            inner = k + 1 < len(stars)
            end[inner] = stars.take(k[inner] + 1)
            tied.add(rank, _keys(text, begin, end - begin + 1, done), k)
            some = True
        again = Sorter([np.int64, np.int64], 1, share)
        count = group_at = sub_at = 0
        new_group = new_sub = True
        held: list[np.ndarray] | None = None

        def settle(rank: np.ndarray, key: np.ndarray, k: np.ndarray, more: bool, again: Sorter = again) -> None:
            """Rank all rows, but for the last one if ``more`` follow."""
            nonlocal count, group_at, sub_at, new_group, new_sub, equal
            n = len(rank) - more
            other_group = rank[1:] != rank[:-1]
            other = other_group | (key[1:] != key[:-1])
            place = count + np.arange(n)
            group_first = np.concatenate([[new_group], other_group])[:n]
            first = np.concatenate([[new_sub], other])[:n]
            last = np.append(other, True)[:n]
            group_of = np.maximum.accumulate(np.where(group_first, place, group_at))
            sub_of = np.maximum.accumulate(np.where(first, place, sub_at))
            now, within = rank[:n] + sub_of - group_of, place - sub_of
            closed = _closed(key[:n], text.kind)
            over = (first & last) | closed | (key[:n] & ended == ended)
            again.add(k[:n][~over], now[~over])
            final.add(k[:n][over], (now + within * closed)[over])
            same = over & ~closed & ~(first & last)
            equal = equal or bool(same.any())
            frequent.extend(now[same & (within == rows)].tolist())
            if n and more:
                group_at, sub_at, new_group, new_sub = int(group_of[-1]), int(sub_of[-1]), bool(other_group[n - 1]), bool(other[n - 1])
            count += n

        for block in tied.read(rows):
            if held is not None:
                block = [np.concatenate([h, b]) for h, b in zip(held, block, strict=True)]
            settle(*block, more=True)
            held = [c[-1:] for c in block]
        if held is not None:
            settle(*held, more=False)
        done += wide
        active = ((k, rank) for k, rank in again.read(rows))
    return final, equal, frequent


def _double(names: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a string of names by doubling the compared length; the end is smaller than any name."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    own = names[order]
    first = np.concatenate([[True], own[1:] != own[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    sizes = np.diff(np.append(np.flatnonzero(first), n))
    active = order[np.repeat(sizes > 1, sizes)]
    span = 1
    while len(active):
        ahead = active + span
        key = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        sort = np.lexsort((key, rank[active]))
        now, own = active[sort], key[sort]
        group = rank[now]
        first = np.concatenate([[True], (own[1:] != own[:-1]) | (group[1:] != group[:-1])])
        begin = np.concatenate([[True], group[1:] != group[:-1]])
        offset = np.arange(len(now)) - np.maximum.accumulate(np.where(begin, np.arange(len(now)), 0))
        rank[now] = group + offset[np.maximum.accumulate(np.where(first, np.arange(len(now)), 0))]
        sizes = np.diff(np.append(np.flatnonzero(first), len(now)))
        active = now[np.repeat(sizes > 1, sizes)]
        span *= 2
    return np.argsort(rank, kind="stable")


def _named_order(names: Vector, frequent: list[int], cap: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Star numbers in the order of their strings of names (0 at the end), with the number of names shared with the one before."""
    rows = batch_rows(memory)
    if len(names) * NAME_BYTES <= memory:
        order = _double(names.read(0, len(names)).astype(np.int64))[1:]
        for a in range(0, len(order), rows):
            own = order[a : a + rows]
            before = np.concatenate([order[a - 1 : a] if a else own[:1], own[:-1]])
            shared = common_prefix(names, before, own, cap)
            shared[: not a] = 0
            yield own, shared
        return
    bounds = np.unique(np.concatenate([[0], np.arange(1, len(names) + 1, rows), np.array(frequent, np.int64) + 1, np.array(frequent, np.int64) + 2]))
    single = np.isin(bounds, np.array([-1, *frequent]) + 1)
    down, shared = Vector(np.int64, memory // 8), Vector(np.int16, memory // 16)
    for place, prefix in _descending(names, Symbols(bounds, single), cap, memory):
        down.append(place)
        shared.append(prefix)
    shared.append(np.zeros(1, np.int16))
    for b in range(len(down), 0, -rows):
        a = max(0, b - rows)
        yield down.read(a, b)[::-1], shared.read(a + 1, b + 1)[::-1].astype(np.int64)


def _sorted_stars(text: Vector, cap: int, memory: int) -> tuple[Vector, Vector]:
    """Places of the stars in the order of their suffixes, and the common prefix of each with the one before."""
    stars = _stars(text, memory)
    ranked, equal, frequent = _ranks(text, stars, memory)
    rows = batch_rows(memory)
    source: Iterable[tuple[np.ndarray, np.ndarray]]
    if equal:
        names = Vector(np.uint32, memory // 8)
        for _, rank in ranked.read(rows):
            names.append(rank + 1)
        names.append(np.zeros(1, np.uint32))
        source = _named_order(names, frequent, cap // 2 + 1, memory)  # stars are two symbols apart or more
    else:
        by_rank = Sorter([np.int64, np.int64], 1, memory // 6)
        for k, rank in ranked.read(rows):
            by_rank.add(rank, k)
        source = ((k, np.zeros(len(k), np.int64)) for _, k in by_rank.read(rows))
    order, prefix, last = Vector(np.int64, memory // 8), Vector(np.int16, memory // 16), None
    for k, shared in source:
        before = np.concatenate([k[:1] if last is None else last, k[:-1]])
        place = stars.take(k)
        after = stars.take(k + shared)
        value = np.minimum(cap, after - place + common_prefix(text, stars.take(before + shared), after, cap))
        if last is None:
            value[:1] = 0
        order.append(place)
        prefix.append(value)
        last = k[-1:]
    return order, prefix


Given = Callable[[int, int, int], tuple[np.ndarray, np.ndarray]]


class _Sweep:
    """One pass over the suffixes in order (``sign`` 1) or from the end (-1): each hands on its predecessor.

    ``given(group, a, b)``: places and common prefixes of suffixes that are known to be in a group, behind those that come
    through the queue; ``given_size`` is their number by group."""

    def __init__(self, text: Vector, symbols: Symbols, given: Given, given_size: np.ndarray, sign: int, cap: int, memory: int) -> None:
        self.text, self.symbols, self.given, self.given_size, self.sign, self.cap = text, symbols, given, given_size, sign, cap
        self.rows, self.queues, self.lows = batch_rows(memory), Queues(memory // 4), []

    def _before(self, place: np.ndarray) -> np.ndarray:
        symbol = self.text.take(np.maximum(place - 1, 0))
        return np.where(place > 0, symbol, 0).astype(self.text.kind)

    def _hand(self, place: np.ndarray, symbol: np.ndarray, keep: np.ndarray, prefix: np.ndarray) -> None:
        """Predecessors ``place`` with their first symbols, in the order of their sources; ``prefix``: of each source with the one before."""
        tag = len(self.lows)
        self.lows.append(int(prefix.min()) if len(prefix) else self.cap)
        at = np.flatnonzero(keep)
        if not len(at):
            return
        order = at[np.argsort(symbol[at], kind="stable")]
        own = symbol[order]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        last = np.append(first[1:], True)
        value, tail = np.empty(len(order), np.int16), np.full(len(order), -1, np.int16)
        later = np.flatnonzero(~first)
        value[later] = np.minimum(range_minimum(prefix, order[later - 1] + 1, order[later]) + 1, self.cap)
        value[first] = -1 - np.minimum.accumulate(prefix)[order[first]]  # negative: the minimum from the batch's beginning on
        rest = np.append(np.minimum.accumulate(prefix[::-1])[::-1], self.cap)
        tail[last] = rest[order[last] + 1]  # and of the last one of a symbol, to the batch's end
        place, group = place[order], self.symbols.group(own)
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(own)), strict=True):
            self.queues.push(int(group[a]), tag, place[a:b], value[a:b], tail[a:b], own[a:b])

    def _resolved(self, tag: np.ndarray, value: np.ndarray, tail: np.ndarray, follows: np.ndarray, before: tuple[int, int] | None) -> np.ndarray:
        """Common prefixes of queued rows with the row before; ``follows``: that has the same symbol; ``before``: (tag, tail) of the one before all."""
        out = np.where(value < 0, 0, value).astype(np.int16)
        at = np.flatnonzero((value < 0) & follows)
        if len(at):
            tag_before = np.concatenate([[before[0] if before else 0], tag[:-1]])[at]
            low = np.minimum(np.concatenate([[before[1] if before else 0], tail[:-1]])[at], -1 - value[at])
            between = np.flatnonzero(tag_before + 1 < tag[at])
            if len(between):
                low[between] = np.minimum(low[between], range_minimum(np.array(self.lows, np.int16), tag_before[between] + 1, tag[at][between] - 1))
            out[at] = np.minimum(low + 1, self.cap)
        return out

    def _one_symbol(self, group: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
        symbol, before, last = int(self.symbols.bounds[group]), None, None
        while (got := self.queues.pop(group, self.rows)) is not None:
            tag, (place, value, tail, _) = got
            follows = np.ones(len(place), bool)
            follows[0] = before is not None
            prefix = self._resolved(tag, value, tail, follows, before)
            before, last = (int(tag[-1]), int(tail[-1])), place[-1:]
            yield False, place, prefix
            found = self._before(place)
            self._hand(place - 1, found, (found >= symbol if self.sign > 0 else found <= symbol) & (found > 0), prefix)
        for a in range(0, int(self.given_size[group]), self.rows):
            place, prefix = self.given(group, a, a + self.rows)
            if not a:
                prefix = prefix.copy()
                prefix[0] = common_prefix(self.text, last, place[:1], self.cap)[0] if last is not None else 0
            yield True, place, prefix
            found = self._before(place)
            self._hand(place - 1, found, (found > symbol if self.sign > 0 else found < symbol) & (found > 0), prefix)

    def _several(self, group: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
        """A range of symbols that fits into a batch: predecessors within the range are followed at once and put into their order."""
        low = int(self.symbols.bounds[group])
        high = int(self.symbols.bounds[group + 1]) if group + 1 < len(self.symbols.bounds) else 1 << 40
        got = self.queues.pop(group, 1 << 62)
        place, symbol, prefix = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16)
        if got is not None:
            tag, (place, value, tail, symbol) = got
            order = np.argsort(symbol.astype(np.int64) * self.sign, kind="stable")
            tag, place, value, tail, symbol = tag[order], place[order], value[order], tail[order], symbol[order].astype(np.int64)
            prefix = self._resolved(tag, value, tail, np.concatenate([[False], symbol[1:] == symbol[:-1]]), None)
        queued = len(place)
        if self.given_size[group]:
            own, shared = self.given(group, 0, int(self.given_size[group]))
            place, prefix = np.concatenate([place, own]), np.concatenate([prefix, shared])
            symbol = np.concatenate([symbol, self.text.take(own).astype(np.int64)])
        if not len(place):
            return
        known = len(place)
        is_given = np.arange(known) >= queued
        source = np.full(known, -1)
        found, keep = [], []
        fresh = slice(0, known)
        while fresh.stop > fresh.start:  # followed until no predecessor is within the range
            p = self._before(place[fresh]).astype(np.int64)
            own = symbol[fresh]
            ahead = np.where(is_given[fresh], p * self.sign > own * self.sign, p * self.sign >= own * self.sign) & (p > 0)
            inside = ahead & (p >= low) & (p < high)
            found.append(p)
            keep.append(ahead & ~inside)
            at = np.flatnonzero(inside) + fresh.start
            place, symbol = np.concatenate([place, place[at] - 1]), np.concatenate([symbol, p[inside]])
            is_given, source = np.concatenate([is_given, np.zeros(len(at), bool)]), np.concatenate([source, at])
            fresh = slice(fresh.stop, len(place))
        found, keep, n = np.concatenate(found), np.concatenate(keep), len(place)
        new = source >= 0
        turn, key = np.zeros(n, np.int64), np.arange(n)
        while True:  # the order of new ones follows the order of their sources
            key[new] = turn[source[new]]
            order = np.lexsort((key, new, is_given, symbol * self.sign))
            before, turn[order] = turn.copy(), np.arange(n)
            if (before == turn).all():
                break
        place, symbol, is_given, new, source = place[order], symbol[order], is_given[order], new[order], source[order]
        value = np.zeros(n, np.int16)
        value[turn[:known]] = prefix
        same = np.concatenate([[False], symbol[1:] == symbol[:-1]])
        value[~same] = 0
        bridge = np.flatnonzero(same & is_given & ~np.concatenate([[False], is_given[:-1]]))
        if len(bridge):
            value[bridge] = common_prefix(self.text, place[bridge - 1], place[bridge], self.cap)
        later = np.flatnonzero(same & new)
        if len(later):
            value[later] = min(1, self.cap)  # a source outside the range and one inside share nothing
            pair = later[new[later - 1]]
            a, b = turn[source[pair - 1]] + 1, turn[source[pair]]
            while len(pair):
                now = np.minimum(range_minimum(value, a, b) + 1, self.cap)
                if (value[pair] == now).all():
                    break
                value[pair] = now
        yield from ((g, place[a:b], value[a:b]) for g, a, b in _stretches(is_given))
        self._hand(place - 1, found[order].astype(self.text.kind), keep[order], value)

    def run(self) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
        """(group, known before, places, common prefixes with the one before) of all suffixes, in order."""
        groups = range(len(self.symbols.bounds))
        for group in groups if self.sign > 0 else reversed(groups[1:]):
            for known, place, prefix in self._one_symbol(group) if self.symbols.single[group] else self._several(group):
                if len(place):
                    yield group, known, place, prefix


def _stretches(flags: np.ndarray) -> Iterator[tuple[bool, int, int]]:
    cuts = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(flags)), strict=True):
        yield bool(flags[a]), int(a), int(b)


def _descending(text: Vector, symbols: Symbols, cap: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes from the largest to the smallest, without those of the symbol 0: places, and the common prefix (up to ``cap``) of each with the larger one before."""
    order, prefix = _sorted_stars(text, cap, memory)
    size, rows = np.zeros(len(symbols.bounds), np.int64), batch_rows(memory)
    for a in range(0, len(order), rows):
        size += np.bincount(symbols.group(text.take(order.read(a, a + rows))), minlength=len(size))
    begin = np.cumsum(size) - size
    place = np.int32 if len(text) < 2**31 else np.int64
    larger, shared, larger_size = Vector(place, memory // 8), Vector(np.int16, memory // 16), np.zeros(len(size), np.int64)

    def stars(group: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        part = (int(begin[group] + a), int(begin[group] + min(b, size[group])))
        return order.read(*part).astype(place), prefix.read(*part)

    for group, known, places, values in _Sweep(text, symbols, stars, size, 1, cap, memory).run():
        if not known:
            larger.append(places)
            shared.append(values)
            larger_size[group] += len(places)
    end = np.cumsum(larger_size)

    def ls(group: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        first, last = int(end[group] - min(b, larger_size[group])), int(end[group] - a)
        values = shared.read(first + 1, last + 1)
        if last == end[group]:
            values = np.append(shared.read(first + 1, last), np.int16(0))
        return larger.read(first, last)[::-1], values[::-1]

    for _, _, places, values in _Sweep(text, symbols, ls, larger_size, -1, cap, memory).run():
        yield places, values


def sorted_suffixes(text: Vector, cap: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of a byte text that ends with 0, from the largest to the smallest, without the closing bytes: places, and
    the common prefix (up to ``cap``) of each with the larger one before. Bytes of 255 do not occur."""
    return _descending(text, BYTES, cap, memory)


def repeated_runs(text: Vector, length: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs [begin, end) of places from which the next ``length`` bytes (within their piece) begin at another place as well, ascending.

    The peak of memory is up to four times ``memory``."""
    memory //= 2
    span = max(1 << 12, memory // 4)
    marks, last = Queues(memory // 8), np.zeros(0, np.int64)
    for place, prefix in sorted_suffixes(text, length, memory):
        hit = np.flatnonzero(prefix >= length)
        if len(hit):
            both = np.concatenate([place[hit], np.concatenate([last, place])[hit - 1 + len(last)]]).astype(np.int64)
            both = both[np.argsort(both // span, kind="stable")]
            number = both // span
            cuts = np.flatnonzero(np.diff(number, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(both)), strict=True):
                marks.push(int(number[a]), 0, both[a:b])
        last = place[-1:].astype(np.int64)
    open_from = -1
    for number in range(-(-len(text) // span)):
        flag = np.zeros(span + 1, bool)
        while (got := marks.pop(number, batch_rows(memory))) is not None:
            flag[got[1][0] - number * span] = True
        edges = np.flatnonzero(np.diff(flag.astype(np.int8), prepend=0)) + number * span
        begin, end = edges[::2], edges[1::2]
        if open_from >= 0 and not (len(begin) and begin[0] == number * span):
            begin, end = np.concatenate([[open_from], begin]), np.concatenate([[number * span], end])
        elif open_from >= 0:
            begin = np.concatenate([[open_from], begin[1:]])
        open_from = -1
        if len(end) and end[-1] == (number + 1) * span:
            open_from, begin, end = int(begin[-1]), begin[:-1], end[:-1]
        if len(begin):
            yield begin, end
    if open_from >= 0:
        yield np.array([open_from]), np.array([len(text)])
