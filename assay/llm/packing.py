"""Hierarchical packing of token sequences into windows of several sizes.

Each task packs the documents it reads. A document's whole windows stand alone;
its rest is routed to the smallest tier (a context size) that holds it. Tiers
are packed from long to short into windows of their own size: a window starts
with the longest document of its tier, its gap is filled from shorter tiers and
at last by cutting a document. What is left at the end of a task goes into
windows of smaller powers of two, so that nothing is padded. Windows of one size
are dealt into step groups of equal token sums across all tasks.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from assay.llm.common import stored, texts_of

# Fixed value: how the vocabulary's library cuts a text before merging.
_CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens that a task gathers before it packs them.
TOKENS_AT_ONCE = 1 << 21
#: Longest run of white space that the fast encoder is given; it gives up at about a million.
LONGEST_BLANK = 100_000


@lru_cache(maxsize=2)
def encoder(ranks_file: str, special: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=_CUT, mergeable_ranks=ranks, special_tokens=dict(special))


@lru_cache(maxsize=2)
def library(json_file: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_file)


def encode_text(text: str, ranks_file: str, json_file: str, special: tuple[tuple[str, int], ...]) -> np.ndarray:
    """Ids as the library for ``json_file`` gives them. ``tiktoken`` gives the
    same at a fraction of the time, but not for very long white space, which
    goes to the library itself."""
    if len(text) > LONGEST_BLANK and max(map(len, re.findall(r"\s+", text)), default=0) > LONGEST_BLANK:
        return np.array(library(json_file).encode(text, add_special_tokens=False).ids, np.uint32)
    return encoder(ranks_file, special).encode_to_numpy(text, allowed_special="all")


class TierPacker:
    """Packs pieces of at most ``window`` ids; yields whole sequences, each as
    long as its tier, as lists of ``(document, start, length)``."""

    def __init__(self, window: int, shortest_tier: int):
        if window & (window - 1):
            raise ValueError("the window must be a power of two")
        self.window = window
        self.tiers = [window >> i for i in range(window.bit_length()) if window >> i >= shortest_tier]

    def pack(self, sizes: list[int]) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
        """Full sequences, and the pieces (less than a window together) left.

        A sequence of a tier begins with the longest piece of that tier; gaps
        take the longest piece that fits, which is one of a shorter tier."""
        window, full = self.window, []
        tiers: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}
        for doc, n in enumerate(sizes):
            whole = n // window
            full.extend([(doc, i * window, window)] for i in range(whole))
            if rest := n - whole * window:
                tier = min((t for t in self.tiers if t >= rest))
                tiers[tier].append((rest, doc, whole * window))
        # One sorted pool per tier; gaps are filled with the longest piece that fits.
        pools = {t: sorted(p) for t, p in tiers.items()}
        while pools:
            tier = max(pools)
            if not pools[tier]:
                del pools[tier]
                continue
            size, doc, start = pools[tier].pop()
            sequence, gap = [(doc, start, size)], tier - size
            while gap:
                found = None
                for t in sorted(pools, reverse=True):
                    if t > 2 * gap and t != self.tiers[-1]:
                        continue
                    at = bisect_right(pools[t], (gap, 1 << 62, 0))
                    if at:
                        found = pools[t].pop(at - 1)
                        break
                if found is None:
                    break
                sequence.append((found[1], found[2], found[0]))
                gap -= found[0]
            if gap:
                # No piece fits whole: the shortest one left is cut.
                left = [t for t in sorted(pools) if pools[t]]
                if not left:
                    return full, sequence
                size, doc, start = pools[left[0]].pop(0)
                sequence.append((doc, start, gap))
                rest = size - gap
                insort(pools.setdefault(min(t for t in self.tiers if t >= rest), []), (rest, doc, start + gap))
            full.append(sequence)
        return full, []

    def finish(self, pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
        """The left pieces in windows of smaller powers of two, without padding."""
        total, out, pieces = sum(p[2] for p in pieces), [], list(pieces)
        for bit in reversed(range(total.bit_length())):
            if total >> bit & 1:
                room, sequence = 1 << bit, []
                while room:
                    doc, start, n = pieces.pop(0)
                    take = min(n, room)
                    sequence.append((doc, start, take))
                    if take < n:
                        pieces.insert(0, (doc, start + take, n - take))
                    room -= take
                out.append(sequence)
        return out


_FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, _task int, _nth long"


def _with_step_groups(pieces: DataFrame, group_tokens: int) -> DataFrame:
    """Number the windows of each size over all tasks and cut the numbers into
    groups of ``group_tokens`` ids. The counts have a row per task and size."""
    counts = pieces.where("offset = 0").groupBy("tier", "_task").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("tier").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tier", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # Sizes are powers of two, so their logarithm tells the groups of sizes apart.
    size = F.length(F.bin(F.col("tier").cast("long"))).cast("long")
    group = F.shiftleft(size, 48) + F.floor((F.col("_before") + F.col("_nth")) * F.col("tier") / group_tokens)
    return pieces.join(starts, ["tier", "_task"]).withColumn("step_group", group).drop("_task", "_nth", "_before")


def pack_documents(
    docs: DataFrame, ranks_file: str, json_file: str, row_id: str = "doc_id", text: str = "text", end_id: int = 0, window: int = 1024,
    shortest_tier: int = 64, group_tokens: int = 8192, special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),),
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``row_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier, step_group`` and, if asked for, the ``ids``.

    A document is its ids and then ``end_id``; a null text is empty, so every
    row has at least one id. Each id lies in exactly one piece; all sequences
    are as long as a tier but for at most one per power of two and task. ``tier`` is
    the sequence's size; sequences of one size form step groups of exactly
    ``group_tokens`` ids (or of one sequence, where that is longer), but for the
    last group of a size. Repeated rows are packed one by one, other columns are
    not read, an empty table gives no rows. Numbers of sequences follow from
    the partition, so a task that runs again gives the same rows.
    """
    rows = docs.select(F.col(row_id).alias("_id"), F.col(text).alias("_text"))
    id_type = docs.schema[row_id].dataType.simpleString()
    packer = TierPacker(window, shortest_tier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        base = task << 36
        number = 0
        names: list = []
        tokens: list[np.ndarray] = []
        shift: list[int] = []
        totals: list[int] = []
        filled: dict[int, int] = {}

        def rows_of(sequences):
            nonlocal number
            out: list[list] = [[] for _ in range(11)]
            for sequence in sequences:
                size = sum(p[2] for p in sequence)
                nth = filled.get(size, 0)
                filled[size] = nth + 1
                offset = 0
                for doc, start, n in sequence:
                    data = tokens[doc][start : start + n].tobytes()
                    values = (names[doc], shift[doc] + start, n, zlib.crc32(data), totals[doc], base + number, offset, size, task, nth, data)
                    for column, v in zip(out, values):
                        column.append(v)
                    offset += n
                number += 1
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.int32(), pa.int64()]
            arrays = [pa.array(out[0], names_type)] + [pa.array(c, k) for c, k in zip(out[1:10], kinds)]
            labels = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "_task", "_nth"]
            if with_ids:
                arrays.append(pa.array(out[10], pa.binary()))
                labels.append("ids")
            return pa.RecordBatch.from_arrays(arrays, labels)

        names_type, held = None, 0
        for batch in batches:
            names_type = batch.schema.field("_id").type
            for name, t in zip(batch.column("_id").to_pylist(), texts_of(batch.column("_text"))):
                ids = np.append(encode_text(t, ranks_file, json_file, special), np.uint32(end_id)).astype("<u4")
                names.append(name), tokens.append(ids), shift.append(0), totals.append(len(ids))
                held += len(ids)
                if held >= TOKENS_AT_ONCE:
                    full, left = packer.pack([len(x) for x in tokens])
                    yield rows_of(full)
                    names = [names[d] for d, _, _ in left]
                    totals = [totals[d] for d, _, _ in left]
                    shift = [shift[d] + s for d, s, _ in left]
                    tokens = [tokens[d][s : s + n].copy() for d, s, n in left]
                    held = sum(map(len, tokens))
        if tokens:
            full, left = packer.pack([len(x) for x in tokens])
            yield rows_of(full + packer.finish(left))

    fields = f"_id {id_type}, {_FIELDS}" + (", ids binary" if with_ids else "")
    packed = _with_step_groups(stored(rows.mapInArrow(run, fields), "pieces"), group_tokens)
    names = ["_id", *[f.split()[0] for f in _FIELDS.split(", ") if not f.startswith("_")], "step_group"] + (["ids"] if with_ids else [])
    return packed.select(*names).withColumnRenamed("_id", row_id)
