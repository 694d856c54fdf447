"""The path search of ``pieces.py`` over the words of many texts at a time.

A word is what lies between two places where a piece must end whatever came
before. The distinct words of some texts are searched side by side: a step of
numpy moves every word that is not done to its next piece, or one piece back.
Nothing is remembered from one call to the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Longer words are searched one by one.
LONG_WORD = 64
#: Neighbours looked up at a time.
BLOCK = 1 << 16


class Lookup:
    """Whole numbers for whole numbers from 0, many at a time; -1 for an unknown one."""

    def __init__(self, entries: dict[int, int]):
        keys, values = np.fromiter(entries.keys(), np.int64, len(entries)), np.fromiter(entries.values(), np.int32, len(entries))
        bits = max(4, (4 * len(entries)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        met, out = self.keys[slot], self.values[slot]
        open_ = np.flatnonzero((met != keys) & (met >= 0))
        out[met != keys] = -1
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.last
            met = self.keys[slot[open_]]
            hit = met == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (met >= 0)]
        return out


class WordSearch:
    """Tables of a ``PieceModel`` as arrays, and the search over them."""

    def __init__(self, model):
        self.model = model
        self.names = [p for p in model.id_of if model.halves(p) != ("", "")]
        index = {p: i for i, p in enumerate(self.names)}
        self.ids = np.array([model.id_of[p] for p in self.names], "<u4")
        self.rank = np.array([model.rank[p] for p in self.names], np.int64)
        self.size = np.array([len(p) for p in self.names], np.int64)
        self.left, self.right = (np.array([index[model.halves(p)[k]] if len(p) > 1 else -1 for p in self.names], np.int64) for k in (0, 1))
        self.spaced = np.array([p[-1] == "▁" for p in self.names], bool)
        #: The longest shorter piece that a piece begins with.
        self.shorter = np.array([next((index[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in index), -1) for p in self.names], np.int64)
        kinds = {c: k for k, c in enumerate(sorted({c for p in model.id_of for c in p}), 1)}
        self.n_kinds, self.top = len(kinds) + 1, max(map(ord, kinds), default=0) + 1
        #: Kind of each character, 0 for one that is in no piece.
        self.kind = np.zeros(self.top + 1, np.int64)
        self.kind[[ord(c) for c in kinds]] = list(kinds.values())
        self.inside = Lookup({kinds[a] * self.n_kinds + kinds[b]: 1 for a, b in model.inside})
        #: Ranks of the pieces that two pieces make up together.
        self.together = Lookup({index[p[:n]] * len(index) + index[p[n:]]: r + 1 for p, r in model.rank.items() for n in range(1, len(p)) if p[:n] in index and p[n:] in index})
        # Beginnings of pieces are nodes; those of one character are numbered like its kind.
        node, steps = dict(kinds), {}
        for p in self.names:
            for n in range(2, len(p) + 1):
                if p[:n] not in node:
                    node[p[:n]] = len(node) + 1
                    steps[node[p[: n - 1]] * self.n_kinds + kinds[p[n - 1]]] = node[p[:n]]
        self.steps, self.piece = Lookup(steps), np.full(len(node) + 1, -1, np.int64)
        for p, i in index.items():
            self.piece[node[p]] = i

    def encode(self, texts: list[str]) -> pa.BinaryArray:
        """Ids (little-endian 32 bits) of normalised texts between safe borders."""
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        cut = np.ones(len(chars) + 1, bool)
        for at in range(0, len(chars) - 1, BLOCK):
            kinds = self.kind[np.minimum(chars[at : at + BLOCK + 1], self.top)]
            cut[at + 1 : at + len(kinds)] = self.inside(kinds[:-1] * self.n_kinds + kinds[1:]) < 0
        cut[bounds] = True
        places = np.flatnonzero(cut)
        words = _binary(4 * places, chars).dictionary_encode()
        ids = self.search(words.dictionary).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1]
        return _binary(ends[np.searchsorted(places, bounds)], ids.buffers()[2])

    def search(self, words: pa.BinaryArray) -> pa.BinaryArray:
        """Ids of different words, each given as its characters in 32 bits."""
        begin = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64) // 4
        chars = np.frombuffer(words.buffers()[2] or b"", "<u4")[: begin[-1]]
        sizes = np.diff(begin)
        kinds = self.kind[np.minimum(chars, self.top)]
        alone = self.piece[kinds]
        hard = (sizes > LONG_WORD) | (np.minimum.reduceat(alone, begin[:-1]) < 0) if len(sizes) else np.zeros(0, bool)
        soft = np.repeat(~hard, sizes)
        found = self._side_by_side(kinds[soft], alone[soft], sizes[~hard])
        on = np.flatnonzero(found >= 0)
        of = np.repeat(np.flatnonzero(~hard), sizes[~hard])[on]
        counts = np.bincount(of, minlength=len(sizes))
        by_hand = {}
        for w in np.flatnonzero(hard).tolist():
            word = chars[begin[w] : begin[w + 1]].tobytes().decode("utf-32-le", "surrogatepass")
            by_hand[w] = self.model.ids(self.model.search(word))
            counts[w] = len(by_hand[w])
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(ends[-1], "<u4")
        ids[np.repeat(~hard, counts)] = self.ids[found[on]]
        for w, own in by_hand.items():
            ids[ends[w] : ends[w + 1]] = own
        return _binary(4 * ends, ids)

    def _side_by_side(self, kinds: np.ndarray, alone: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The piece that starts at each character, -1 where none does. Depth
        first and longest piece first, as ``PieceModel.search``."""
        stop = np.cumsum(sizes)
        longest = self._longest(kinds, alone, np.repeat(stop, sizes) - np.arange(len(kinds)))
        found, came, dead = np.full(len(kinds), -1, np.int64), np.zeros(len(kinds) + 1, np.int64), np.zeros(len(kinds) + 1, bool)
        start = at = stop - sizes
        before, piece = np.full(len(sizes), -1, np.int64), longest[at]
        while len(at):
            to = at + self.size[piece]
            ok = ~dead[to] | (to == stop)
            ok[ok] = self.apart(before[ok], piece[ok])
            found[at[ok]], came[to[ok]] = piece[ok], at[ok]
            at, before = np.where(ok, to, at), np.where(ok, piece, before)
            piece = np.where(ok, longest[np.minimum(at, len(kinds) - 1)], self.shorter[piece])
            # No piece is left: go back over one, and over one more if that was the shortest.
            back = np.flatnonzero(piece < 0)
            while len(back):
                if (at[back] == start[back]).any():
                    raise ValueError("no path through the text")
                dead[at[back]], found[at[back]] = True, -1
                at[back] = came[at[back]]
                piece[back] = self.shorter[found[at[back]]]
                before[back] = np.where(at[back] == start[back], -1, found[came[at[back]]])
                back = back[piece[back] < 0]
            more = at < stop
            if not more.all():
                at, before, piece, start, stop = at[more], before[more], piece[more], start[more], stop[more]
        return found

    def _longest(self, kinds: np.ndarray, alone: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The longest piece that starts at each character, ``left`` characters at most."""
        out, n = alone.copy(), 1
        at = np.flatnonzero(left > 1)
        node = kinds[at]
        while len(at):
            node = self.steps(node * self.n_kinds + kinds[at + n])
            goes = node >= 0
            at, node, n = at[goes], node[goes].astype(np.int64), n + 1
            piece = self.piece[node]
            ends = piece >= 0
            out[at[ends]] = piece[ends]
            goes = left[at] > n
            at, node = at[goes], node[goes]
        return out

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``PieceModel.beside`` for many pairs; -1 on the left is the border of a word."""
        out = left < 0
        merged = ~out & (self.spaced[left] | (left == right))
        if merged.any():
            pairs, of = np.unique(left[merged] * len(self.names) + right[merged], return_inverse=True)
            beside, names = self.model.beside, self.names
            out[merged] = np.array([beside(names[a], names[b]) for a, b in zip(*(x.tolist() for x in np.divmod(pairs, len(names))))], bool)[of]
        at = np.flatnonzero(~merged & ~out)
        left, right, limit = left[at], right[at], np.full(len(at), 1 << 60)
        while len(at):
            # Ranks are kept plus one: 0 is that of characters, -1 stands for no piece.
            rank = self.together(left * len(self.names) + right)
            a, b = self.rank[left], self.rank[right]
            open_ = (rank < 0) | (rank > limit)
            done = open_ & (a < 0) & (b < 0)
            out[at[done]] = True
            open_ &= ~done
            at, left, right, limit, a, b = at[open_], left[open_], right[open_], limit[open_], a[open_], b[open_]
            later = a > b
            limit = np.where(later, a, b + 1)
            left, right = np.where(later, self.right[left], left), np.where(later, right, self.left[right])
        return out


def _binary(ends: np.ndarray, data) -> pa.BinaryArray:
    """Byte strings that lie one after the other in ``data``."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data if data is not None else b"")])
