"""Suffix order of a text on disk by induced sorting.

The text, the order and every list that grows with it live in scratch files of
the task; what is in memory is bounded by ``limit`` tuples. Suffixes whose
symbol is smaller than both neighbours' (the stars) are named by a first
induction, ordered by recursion on their names, and seed a second induction
that carries common prefixes along: a suffix tuple (position, common prefix with
the tuple before it) that is popped from the queues pushes the tuple of the
suffix one symbol longer, whose common prefix is one more than the least one
popped since the last push to the same symbol.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples that are worked on at a time.
BLOCK = 1 << 18


def place_type(n: int):
    """The narrowest type for places in a text of ``n`` symbols."""
    return np.int32 if n < 1 << 31 else np.int64


def scratch_array(n: int, dtype) -> np.ndarray:
    """An array in a scratch file, which goes with the last reference to it."""
    with tempfile.TemporaryFile() as file:
        file.truncate(max(1, n) * np.dtype(dtype).itemsize)
        return np.memmap(file, dtype, "r+", shape=(max(1, n),))[:n]


class Tape:
    """A list on disk: appended to at the end, read anywhere."""

    def __init__(self, *dtypes):
        self.files = [tempfile.TemporaryFile() for _ in dtypes]
        self.dtypes = [np.dtype(d) for d in dtypes]
        self.size = 0

    def append(self, *columns: np.ndarray) -> None:
        for file, dtype, column in zip(self.files, self.dtypes, columns):
            file.write(np.ascontiguousarray(column, dtype).tobytes())
        self.size += len(columns[0])

    def read(self, start: int, stop: int) -> list[np.ndarray]:
        out = []
        for file, dtype in zip(self.files, self.dtypes):
            file.flush()
            out.append(np.frombuffer(os.pread(file.fileno(), (stop - start) * dtype.itemsize, start * dtype.itemsize), dtype))
        return out

    def blocks(self, size: int = BLOCK) -> Iterator[list[np.ndarray]]:
        for start in range(0, self.size, size):
            yield self.read(start, min(start + size, self.size))


class SymbolQueue:
    """Priority queue of suffix tuples on disk: by first symbol, then by arrival.

    Tuples wait in memory until there are ``limit`` of them and are then
    appended to a scratch tape, symbol by symbol.
    """

    def __init__(self, limit: int, places=np.int64):
        self.limit, self.held, self.places = limit, 0, places
        self.waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.extents: dict[int, list[tuple[int, int]]] = {}
        self.tape: Tape | None = None

    def push(self, symbols: np.ndarray, positions: np.ndarray, common: np.ndarray) -> None:
        """Tuples sorted by symbol, in order of arrival within one."""
        if not len(symbols):
            return
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(symbols)]
        for symbol, a, b in zip(symbols[starts].tolist(), starts, ends):
            self.waiting.setdefault(symbol, []).append((positions[a:b], common[a:b]))
        self.held += len(symbols)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.tape = self.tape or Tape(self.places, np.uint8)
        for symbol, parts in self.waiting.items():
            for positions, common in parts:
                self.extents.setdefault(symbol, []).append((self.tape.size, self.tape.size + len(positions)))
                self.tape.append(positions, common)
        self.waiting, self.held = {}, 0

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples of a symbol, also those pushed meanwhile, in blocks."""
        while True:
            if extents := self.extents.pop(symbol, None):
                taken = []
                for start, stop in extents:
                    for a in range(start, stop, BLOCK):
                        taken.append(self.tape.read(a, min(a + BLOCK, stop)))
                        if sum(len(t[0]) for t in taken) >= BLOCK:
                            yield _joined(taken)
                            taken = []
                if taken:
                    yield _joined(taken)
            elif parts := self.waiting.pop(symbol, None):
                self.held -= sum(len(p[0]) for p in parts)
                positions, common = _joined(parts)
                for a in range(0, len(positions), BLOCK):
                    yield positions[a : a + BLOCK], common[a : a + BLOCK]
            else:
                return


def _joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0][0], parts[0][1]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffixes, ``cap`` at most; the text goes on for ``cap`` symbols."""
    windows, out = np.lib.stride_tricks.sliding_window_view(text, cap), np.empty(len(a), np.uint8)
    for at in range(0, len(a), 1 << 15):
        part = slice(at, at + (1 << 15))
        differ = windows[a[part]] != windows[b[part]]
        out[part] = np.where(differ.any(axis=1), differ.argmax(axis=1), cap)
    return out


class _Prefixes:
    """Least common prefix popped since the last push to each symbol."""

    def __init__(self, symbols: int, cap: int):
        self.since, self.cap = np.full(symbols, -1, np.int16), cap

    def of(self, common: np.ndarray, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """For pushes of the popped tuples ``at``, sorted by symbol and arrival."""
        until = np.minimum.accumulate(common)
        first = np.r_[True, symbols[1:] != symbols[:-1]] if len(symbols) else np.zeros(0, bool)
        out = np.empty(len(at), np.int16)
        start = np.flatnonzero(first)
        before = self.since[symbols[start]]
        out[start] = np.where(before < 0, -1, np.minimum(before, until[at[start]]))
        later = np.flatnonzero(~first)
        if len(later):
            low, high = at[later - 1] + 1, at[later]
            span = high - low + 1
            level = np.frexp(span.astype(np.float64))[1] - 1
            table = common
            for k in range(int(level.max()) + 1):
                mine = np.flatnonzero(level == k)
                if len(mine):
                    out[later[mine]] = np.minimum(table[low[mine]], table[high[mine] - (1 << k) + 1])
                if len(table) > 1 << k:
                    table = np.minimum(table[: -(1 << k)], table[1 << k :])
        known = self.since >= 0
        self.since[known] = np.minimum(self.since[known], until[-1])
        if len(start):
            last = at[np.r_[start[1:], len(at)] - 1]
            after = np.r_[np.minimum.accumulate(common[::-1])[::-1], np.uint8(self.cap)]
            self.since[symbols[start]] = after[last + 1]
        return np.minimum(out + 1, self.cap).astype(np.uint8)


def _induce(text: np.ndarray, n: int, symbols: np.ndarray, seeds: SymbolQueue, limit: int, cap: int) -> Tape:
    """All suffixes from the largest to the smallest, with their common prefix
    with the one before, from the stars in order."""
    places = place_type(n)
    queue, larger, ranges = SymbolQueue(limit, places), Tape(places, np.uint8), {}
    prefixes = _Prefixes(int(symbols[-1]) + 1, cap) if cap else None

    def scan(positions, common, symbol, down: bool, own: bool):
        at = np.flatnonzero(positions > 0)
        before = positions[at] - 1
        d = text[before]
        push = (d < symbol if down else d > symbol) | (d == symbol if own else False)
        at, before, d = at[push], before[push], d[push]
        order = np.argsort(d, kind="stable")
        at, before, d = at[order], before[order], d[order]
        queue.push(d, before, prefixes.of(common, at, d) if cap else np.zeros(len(d), np.uint8))

    for symbol in symbols.tolist():
        start, last = larger.size, None
        for positions, common in queue.pop(symbol):
            larger.append(positions, common)
            scan(positions, common, symbol, False, True)
            last = positions[-1]
        ranges[symbol] = (start, larger.size)
        for positions, common in seeds.pop(symbol):
            if cap and last is not None:
                common = common.copy()
                common[0] = common_prefix(text, np.array([last]), positions[:1], cap)[0]
                last = None
            scan(positions, common, symbol, False, False)

    queue, out = SymbolQueue(limit, places), Tape(places, np.uint8)
    prefixes = _Prefixes(int(symbols[-1]) + 1, cap) if cap else None
    for symbol in symbols[::-1].tolist():
        last = None
        for positions, common in queue.pop(symbol):
            out.append(positions, common)
            scan(positions, common, symbol, True, True)
            last = positions[-1]
        start, stop = ranges[symbol]
        for b in range(stop, start, -BLOCK):
            a = max(start, b - BLOCK)
            positions, common = larger.read(a, min(b + 1, stop))
            positions, common = positions[: b - a][::-1], np.r_[common, np.uint8(0)][1 : b - a + 1][::-1]
            if cap and last is not None:
                common = common.copy()
                common[0] = common_prefix(text, np.array([last]), positions[:1], cap)[0]
                last = None
            out.append(positions, common)
            scan(positions, common, symbol, True, False)
    out.append(np.array([n - 1]), np.zeros(1, np.uint8))  # the end, which nothing induces
    return out


def _stars(text: np.ndarray, n: int) -> np.ndarray:
    """Positions of the suffixes smaller than both neighbours, the end included."""
    smaller = scratch_array(n, np.bool_)
    smaller[n - 1] = True
    for b in range(n - 1, 0, -BLOCK):
        a = max(0, b - BLOCK)
        here, there = text[a:b], text[a + 1 : b + 1]
        told = np.flatnonzero(here != there)
        at = np.searchsorted(told, np.arange(b - a))
        values = np.r_[here[told] < there[told], smaller[b]]
        smaller[a:b] = values[at]
    count = sum(int((smaller[a + 1 : min(a + BLOCK, n - 1) + 1] & ~smaller[a : min(a + BLOCK, n - 1)]).sum()) for a in range(0, n - 1, BLOCK))
    out, filled = scratch_array(max(1, count), place_type(n)), 0
    if n == 1:
        out[0] = 0
        return out
    for a in range(0, n - 1, BLOCK):
        b = min(a + BLOCK, n - 1)
        found = np.flatnonzero(smaller[a + 1 : b + 1] & ~smaller[a:b]) + a + 1
        out[filled : filled + len(found)] = found
        filled += len(found)
    return out


def _same_pieces(text: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the ``lengths`` symbols at ``a`` and ``b`` are equal."""
    same, active, off = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(active):
        for k in range(8):
            x = np.minimum(off + k, lengths[active] - 1)
            same[active] &= text[a[active] + x] == text[b[active] + x]
        off += 8
        active = active[same[active] & (lengths[active] > off)]
    return same


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix order of a short string in memory. A rank is the first place of
    its group; only groups of more than one suffix are sorted on."""
    n, step = len(names), 1
    names = np.asarray(names, np.int64)
    order = np.argsort(names, kind="stable")

    def grouped(places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Rank the suffixes at sorted places and return the places still tied."""
        new = np.r_[True, keys[1:] != keys[:-1]]
        start = np.flatnonzero(new)
        rank[order[places]] = np.repeat(places[start], np.diff(np.r_[start, len(places)]))
        return places[~(new & np.r_[new[1:], True])]

    rank = np.empty(n, np.int64)
    tied = grouped(np.arange(n), names[order])
    while len(tied):
        suffix = order[tied]
        second = np.where(suffix + step < n, rank[np.minimum(suffix + step, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 2) + second
        by = np.argsort(key, kind="stable")
        order[tied] = suffix[by]
        tied = grouped(tied, key[by])
        step *= 2
    return order


def sort_suffixes(text: np.ndarray, n: int, limit: int, cap: int = 0) -> Tape:
    """A tape of ``(position, common)``, the largest suffix first.

    ``text`` has ``n`` symbols, the last one the only 0, and after them room for
    ``cap`` more. ``common`` is the common prefix with the suffix before it on
    the tape, ``cap`` at most; without ``cap`` it is not kept. Strings of names
    that fit ``limit`` are ordered in memory, longer ones by this function again.
    """
    counts = {}
    for a in range(0, n, BLOCK):
        for s, c in zip(*np.unique(text[a : min(a + BLOCK, n)], return_counts=True)):
            counts[int(s)] = counts.get(int(s), 0) + int(c)
    symbols = np.array(sorted(counts), np.int64)
    stars = _stars(text, n)

    seeds = SymbolQueue(limit, place_type(n))
    for a in range(0, len(stars), BLOCK):
        part = np.asarray(stars[a : a + BLOCK])
        d = text[part]
        order = np.argsort(d, kind="stable")
        seeds.push(d[order], part[order], np.zeros(len(part), np.uint8))
    named = _induce(text, n, symbols, seeds, limit, 0)

    # Names of the pieces between stars, in order; equal pieces get equal names.
    place = scratch_array(n, place_type(n))
    for a in range(0, len(stars), BLOCK):
        part = stars[a : a + BLOCK]
        place[part] = np.arange(a + 1, a + 1 + len(part))
    names, number, last = scratch_array(len(stars), place_type(len(stars))), -1, None
    for b in range(named.size, 0, -BLOCK):
        positions = named.read(max(0, b - BLOCK), b)[0][::-1]
        index = place[positions]
        index = index[index > 0].astype(np.int64) - 1
        if not len(index):
            continue
        both = np.r_[[] if last is None else [last], index].astype(np.int64)
        start = stars[both]
        length = np.where(both + 1 < len(stars), stars[np.minimum(both + 1, len(stars) - 1)] - start + 1, 1)
        same = np.zeros(len(both) - 1, bool)
        equal = np.flatnonzero(length[1:] == length[:-1])
        same[equal] = _same_pieces(text, start[equal], start[equal + 1], length[equal])
        new = np.r_[[True] if last is None else [], ~same].astype(np.int64)
        value = number + np.cumsum(new)
        names[index] = value
        number, last = int(value[-1]), int(index[-1])
    del named, place

    if number + 1 == len(stars):
        order = scratch_array(len(stars), place_type(n))
        for a in range(0, len(stars), BLOCK):
            part = np.asarray(names[a : a + BLOCK])
            order[part] = np.arange(a, a + len(part))
        parts = (np.asarray(order[a : a + BLOCK]) for a in range(0, len(order), BLOCK))
    elif len(stars) <= limit:
        order = _by_doubling(names)
        parts = (order[a : a + BLOCK] for a in range(0, len(order), BLOCK))
    else:
        inner = sort_suffixes(names, len(stars), limit)
        parts = (inner.read(max(0, b - BLOCK), b)[0][::-1] for b in range(inner.size, 0, -BLOCK))

    seeds, before = SymbolQueue(limit, place_type(n)), None
    for part in parts:
        positions = stars[part]
        common = np.zeros(len(part), np.uint8)
        if cap:
            previous = np.r_[positions[0] if before is None else before, positions[:-1]]
            common = common_prefix(text, previous, positions, cap)
            if before is None:
                common[0] = 0
            before = positions[-1]
        seeds.push(text[positions], positions, common)
    return _induce(text, n, symbols, seeds, limit, cap)
