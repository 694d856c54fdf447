"""Token counts by rank-synchronous merging over ragged numpy arrays."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from assay.llm.common import arrow_stage, texts_of

# Fixed value: how the vocabulary's library cuts a text before merging.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_NEVER = np.iinfo(np.int32).max
#: Characters and known words that a task holds at a time.
TEXT_AT_ONCE = 1 << 21
KNOWN_WORDS = 400_000


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class MergeTable:
    """Ranks of symbol pairs of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_symbol = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.byte_symbol[byte] = vocabulary[letter]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = max(vocabulary.values()) + 1
        pair = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in merges], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pair, self.rank = pair[order], order.astype(np.int32)
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.special_cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.cut = regex.compile(CUT)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
        return np.where(self.pair[at] == wanted, self.rank[at], _NEVER)

    def count_symbols(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word when no pair can merge any more.

        All words stand in one array. In every round each word's lowest-rank
        pair merges at all its places at once, leftmost first where places
        overlap; words without such a pair leave the array.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        counts = size.copy()
        symbol = self.byte_symbol[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(symbol), _NEVER, np.int32)
        if len(symbol) > 1:
            inside = word[:-1] == word[1:]
            rank[:-1][inside] = self.ranks(symbol[:-1][inside], symbol[1:][inside])
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(symbol)])
            counts[word[starts]] = length
            open_ = lowest < _NEVER
            if not open_.all():
                keep = np.repeat(open_, length)
                symbol, word, rank = symbol[keep], word[keep], rank[keep]
                lowest, length = lowest[open_], length[open_]
                if not len(symbol):
                    break
            merge = rank == np.repeat(lowest, length)
            follows = np.r_[False, merge[1:] & merge[:-1]]
            if follows.any():
                # In a run of overlapping places every second one merges.
                at = np.arange(len(merge))
                run = np.maximum.accumulate(np.where(merge & ~follows, at, 0))
                merge &= (at - run) % 2 == 0
            place = np.flatnonzero(merge)
            symbol[place] = self.made[rank[place]]
            gone = np.zeros(len(symbol), bool)
            gone[place + 1] = True
            changed = np.zeros(len(symbol), bool)
            changed[place] = True
            changed[place[place > 0] - 1] = True
            before = place - 2
            before = before[before >= 0]
            changed[before[gone[before + 1]]] = True
            keep = ~gone
            symbol, word, rank, changed = symbol[keep], word[keep], rank[keep], changed[keep]
            todo = np.flatnonzero(changed)
            last = todo + 1 >= len(symbol)
            inner = todo[~last]
            same = word[inner] == word[inner + 1]
            rank[todo] = _NEVER
            inner = inner[same]
            rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        return counts


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


class TokenCounter:
    """Counts texts; remembers words so that common ones are merged once."""

    def __init__(self, path: str):
        self.table = merge_table(path)
        self.known: dict[str, int] = {}

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known = {}
            new = list(words)
        if new:
            self.known.update(zip(new, self.table.count_symbols([w.encode() for w in new]).tolist()))

    def _pieces(self, text: str) -> tuple[list[str], int]:
        if self.table.special_cut is None:
            return [text], 0
        parts = self.table.special_cut.split(text)
        return parts, len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        out, at = [0] * len(texts), 0
        while at < len(texts):
            lists, size = [], 0
            while at < len(texts) and size < TEXT_AT_ONCE:
                if len(texts[at]) > TEXT_AT_ONCE:
                    out[at] = self._count_long(texts[at])
                else:
                    parts, special = self._pieces(texts[at])
                    out[at] = special
                    lists.append((at, [w for p in parts for w in self.table.cut.findall(p)] if special else self.table.cut.findall(texts[at])))
                    size += len(texts[at])
                at += 1
            self._learn(set().union(*[words for _, words in lists]))
            known = self.known.__getitem__
            for i, words in lists:
                out[i] += sum(map(known, words))
        return out

    def _count_long(self, text: str) -> int:
        parts, total = self._pieces(text)
        for part in parts:
            found = self.table.cut.finditer(part)
            while words := [m[0] for m in islice(found, 1 << 18)]:
                self._learn(set(words))
                total += sum(map(self.known.__getitem__, words))
        return total


@lru_cache(maxsize=1)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, row_id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """``row_id, n_bytes, n_tokens, over_limit`` for every row.

    ``tokenizer`` is the path of a byte-level vocabulary file, present on every
    executor. A null text is empty and has no tokens; special strings inside a
    text count as one token each, as the file's library has it by default.
    Repeated rows are counted one by one, other columns are not read, an empty
    table gives no rows. Texts are counted whole and in bounded portions.
    """
    rows = docs.select(F.col(row_id).alias("_id"), F.col(text).alias("_text"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column("_text"))
        n = _counter(tokenizer).count(texts)
        size = pa.array([len(t.encode()) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("_id"), size, pa.array(n, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    id_type = docs.schema[row_id].dataType.simpleString()
    counted = arrow_stage(rows, f"_id {id_type}, n_bytes long, n_tokens long", step)
    return counted.select(F.col("_id").alias(row_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
