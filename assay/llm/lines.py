"""Line dedup within a few edits, by partitioning lines into segments.

A line cut into ``edits + 1`` segments keeps at least one of them whole under
``edits`` edits. Every distinct line is indexed by its segments; it probes the
indexes of its own and the next smaller lengths with those of its substrings
that can be such a segment, allowing for the edits on either side of it. Pairs
that meet and whose letters could agree are verified by banded bit-parallel
edit distance. Lines that share a key with many others are compared inside
tasks, in bounded blocks, which give out no pairs but the lines that go. Lines
are compared as UTF-8 bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from assay.llm.blocks import pairs_in_block, to_blocks
from assay.llm.common import arrow_stage, stored, texts_of

EDITS = 2
LEAST_BYTES = 24
#: Cells (pairs times bytes) that are verified side by side.
CELLS_AT_ONCE = 1 << 22
#: Rows of a key up to which its pairs are emitted; the lines of other keys are
#: compared in blocks of two chunks of ``CHUNK`` lines, small keys in bins.
HOT_ROWS, CHUNK, ROWS_PER_BIN = 16, 256, 1024
#: Pairs of a block that wait to be verified together.
PAIRS_AT_ONCE = 4096
#: What a line has that is not blank.
_INK = r"[^\x20\x09-\x0D]"


def segments(size: int, edits: int) -> list[tuple[int, int]]:
    """``(start, length)`` of each segment, lengths as even as can be."""
    n = edits + 1
    base, longer = divmod(size, n)
    out, at = [], 0
    for i in range(n):
        width = base + (i >= n - longer)
        out.append((at, width))
        at += width
    return out


def probes(size: int, edits: int) -> list[tuple[int, int, int, int]]:
    """``(indexed length, segment, start, width)`` of the substrings that a line
    of ``size`` bytes looks up: a shift is only possible within the edits that
    can lie before the segment and those that can lie after it."""
    out = []
    for other in range(max(0, size - edits), size + 1):
        gap = size - other
        for i, (start, width) in enumerate(segments(other, edits)):
            left = max(start - i, start + gap - (edits - i), 0)
            right = min(start + i, start + gap + (edits - i), size - width)
            out.extend((other, i, at, width) for at in range(left, right + 1))
    return out


def letters(line: bytes) -> int:
    """32 bits: which byte classes occur an odd number of times. An edit changes
    at most two of them."""
    odd = np.bincount(np.frombuffer(line, np.uint8) & 31, minlength=32) & 1
    return int.from_bytes(np.packbits(odd.astype(np.uint8)).tobytes(), "big")


def edit_distance_within(left: list[bytes], right: list[bytes], edits: int) -> np.ndarray:
    """Is the edit distance of each pair at most ``edits`` (under 31)?

    One bit-parallel column of the band per byte, for all pairs at once; pairs
    of like length are verified together.
    """
    out = np.zeros(len(left), bool)
    m = np.fromiter(map(len, left), np.int64, len(left))
    n = np.fromiter(map(len, right), np.int64, len(right))
    order = np.argsort(np.maximum(m, n), kind="stable")
    order = order[np.abs(m - n)[order] <= edits]
    short = order[np.minimum(m, n)[order] <= edits]
    for i in short:
        out[i] = _plain_distance(left[i], right[i]) <= edits
    order = order[np.minimum(m, n)[order] > edits]
    while len(order):
        width = max(m[order[0]], n[order[0]])
        # As many pairs as fit, not more than half as long again as the first.
        size = int(np.searchsorted(np.maximum(m, n)[order], max(width * 3 // 2, width + 8), side="right"))
        size = max(1, min(size, int(CELLS_AT_ONCE // max(1, width))))
        part, order = order[:size], order[size:]
        out[part] = _banded([left[i] for i in part], [right[i] for i in part], m[part], n[part], edits) <= edits
    return out


def _plain_distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _banded(left: list[bytes], right: list[bytes], m: np.ndarray, n: np.ndarray, edits: int) -> np.ndarray:
    pairs, deep = len(left), int(max(m.max(), n.max()))
    pattern = np.full((pairs, deep + 2 * edits + 1), 256, np.int16)  # stands ``edits`` places to the right
    text = np.full((pairs, deep), 257, np.int16)
    for i, (a, b) in enumerate(zip(left, right)):
        pattern[i, edits : edits + len(a)] = np.frombuffer(a, np.uint8)
        text[i, : len(b)] = np.frombuffer(b, np.uint8)
    pattern, text = np.ascontiguousarray(pattern.T), np.ascontiguousarray(text.T)
    one, low = np.uint64(1), np.uint64(63 - 2 * edits)
    vp = np.full(pairs, np.uint64(((1 << (edits + 1)) - 1) << (63 - edits)))
    vn = np.zeros(pairs, np.uint64)
    distance = np.full(pairs, edits, np.int64)
    edge = np.full(pairs, np.uint64(1 << 62))
    for i in range(int(n.max())):
        x = np.zeros(pairs, np.uint64)
        for k in range(2 * edits + 1):
            x |= (pattern[i + k] == text[i]).astype(np.uint64) << (low + np.uint64(k))
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        going = i < n
        slant = i < m - edits
        step = np.where(slant, (d0 >> np.uint64(63) == 0).astype(np.int64), (hp & edge != 0).astype(np.int64) - (hn & edge != 0).astype(np.int64))
        distance += np.where(going, step, 0)
        edge = np.where(slant, edge, edge >> one)
        half = d0 >> one
        vp = hn | ~(half | hp)
        vn = half & hp
    return distance


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _postings(edits: int):
    tables: dict[int, tuple[list, list]] = {}
    digest = xxhash.xxh3_64_intdigest

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, docs, marks = [], [], []
        for k, text, wanted in zip(batch.column("_k").to_pylist(), texts_of(batch.column("_text")), batch.column("firsts").to_pylist()):
            lines = text.encode().split(b"\n")
            for n in set(wanted):
                line = lines[n]
                size = len(line)
                if size not in tables:
                    if len(tables) > 20_000:
                        tables.clear()
                    own = [(i + (size << 3), a, a + w) for i, (a, w) in enumerate(segments(size, edits))]
                    # An index row is a probe of its own key as well.
                    tables[size] = own, [p for o, i, a, w in probes(size, edits) if (p := (i + (o << 3), a, a + w)) not in own]
                own, others = tables[size]
                mark = letters(line) << 32 | n << 1
                found = [digest(line[a:b], seed) for seed, a, b in own]
                keys += found
                marks += [mark] * len(own)
                found = {digest(line[a:b], seed) for seed, a, b in others}
                keys += found
                marks += [mark | 1] * len(found)
                docs += [k] * (len(own) + len(found))
        key = np.array(keys, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(docs, pa.int64()), pa.array(np.array(marks, np.uint64).view(np.int64))], ["key", "_k", "mark"])

    return step


def _near_earlier(edits: int):
    """The lines of a block that have an earlier one within ``edits`` in it;
    once one is found, a line is not compared with further ones."""

    def run(block: pa.Table) -> pa.Table:
        order = pc.sort_indices(block, sort_keys=[("_id", "ascending"), ("_k", "ascending"), ("n", "ascending")], null_placement="at_start")
        block = block.take(order)
        k, n, mark = (block.column(c).to_numpy() for c in ("_k", "n", "mark"))
        _, place = np.unique(np.column_stack([k, n]), axis=0, return_inverse=True)
        place, probing, marks = place.ravel(), mark & 1, (mark.view(np.uint64) >> np.uint64(32))
        lines = [t.encode() for t in texts_of(block.column("line"))]
        gone = np.zeros(len(k), bool)

        waiting, held = [], 0

        def settle() -> None:
            nonlocal held
            first, then = (np.concatenate(x) for x in zip(*waiting))
            still = ~gone[place[then]]
            first, then = first[still], then[still]
            near = edit_distance_within([lines[x] for x in first], [lines[x] for x in then], edits)
            gone[place[then[near]]] = True
            waiting.clear()
            held = 0

        def visit(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal held
            first, then = np.minimum(i, j), np.maximum(i, j)  # rows are in the order of the lines
            ask = ~gone[place[then]] & (place[i] != place[j]) & (probing[i] + probing[j] < 2) & (np.bitwise_count(marks[i] ^ marks[j]) <= 2 * edits)
            if ask.any():
                waiting.append((first[ask], then[ask]))
                held += len(waiting[-1][0])
            if held >= PAIRS_AT_ONCE:
                settle()

        pairs_in_block(*(block.column(c).to_numpy() for c in ("key", "chunk", "first_chunk", "last_chunk")), visit)
        if waiting:
            settle()
        out = np.unique(place[gone[place]], return_index=True)[1]
        at = np.flatnonzero(gone[place])[out]
        return pa.table({"_k": pa.array(k[at], pa.int64()), "n": pa.array(n[at], pa.int32())})

    return run


def line_verdicts(keyed: DataFrame, edits: int, least_bytes: int, short_repeats: bool = False) -> DataFrame:
    """``_k`` and ``kept``: the numbers of the lines of at least ``least_bytes``
    bytes (with ``short_repeats``, of all lines but blank ones) that stay, for
    each document (``_id``, ``_k``, ``_text``) that keeps any."""
    long = F.octet_length("line") >= least_bytes
    line = keyed.select("_id", "_k", F.posexplode(_lines(F.col("_text"))).alias("n", "line")).where(long | F.col("line").rlike(_INK) if short_repeats else long)
    firsts = line.groupBy(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")).agg(F.min(F.struct("_id", "_k", "n")).alias("at"), F.max(long).alias("long"))
    firsts = stored(firsts.select("at._k", "at.n", "long"), "firsts")
    texts = keyed.select("_id", "_k", "_text")
    # Tables that grow with the input are joined by sorting at every size: a plan that changes with it would move more texts at a larger one.
    listed = texts.join(firsts.where("long").groupBy("_k").agg(F.collect_list("n").alias("firsts")).hint("merge"), "_k")
    postings = arrow_stage(listed.select("_k", "_text", "firsts"), "key long, _k long, mark long", _postings(edits))

    def number(c: str) -> Column:
        return F.shiftright(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int")

    # Index rows (mark even) meet all rows of their key; a key of one line, or without an index row, says nothing.
    key, role = Window.partitionBy("key"), F.col("mark").bitwiseAND(F.lit(1))
    spread = [F.min("_k").over(key) < F.max("_k").over(key), F.min(number("mark")).over(key) < F.max(number("mark")).over(key)]
    counted = postings.select("*", F.count("*").over(key).alias("rows"), (spread[0] | spread[1]).alias("several"), F.min(role).over(key).alias("least"))
    met = stored(counted.where("several and least = 0").select("key", "_k", number("mark").alias("n"), "mark", "rows"), "met")
    few = met.where(F.col("rows") <= HOT_ROWS)
    a, b = few.alias("a"), few.alias("b")
    apart = F.bit_count(F.shiftrightunsigned(F.col("a.mark").bitwiseXOR(F.col("b.mark")), 32)) <= 2 * edits
    before = F.struct("a._k", "a.n") < F.struct("b._k", "b.n")
    other = (F.col("a._k") != F.col("b._k")) | (F.col("a.n") != F.col("b.n"))
    roles = (F.col("a.mark").bitwiseAND(F.lit(1)) == 0) & ((F.col("b.mark").bitwiseAND(F.lit(1)) == 1) | before)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & roles & apart & other)
    pairs = stored(pairs.select(F.col("a._k").alias("ak"), F.col("a.n").alias("an"), F.col("b._k").alias("bk"), F.col("b.n").alias("bn")).distinct(), "pairs")
    hot = met.where(F.col("rows") > HOT_ROWS).groupBy("key", "_k", "n").agg(F.min("mark").alias("mark"))  # the index row of equal ones
    wanted = pairs.select(F.inline(F.array(F.struct(F.col("ak").alias("_k"), F.col("an").alias("n")), F.struct(F.col("bk").alias("_k"), F.col("bn").alias("n"))))).unionByName(hot.select("_k", "n")).distinct()
    fetched = (
        texts.join(wanted.groupBy("_k").agg(F.collect_list("n").alias("ns")).hint("merge"), "_k")
        .select("_id", "_k", "ns", _lines(F.col("_text")).alias("lines"))
        .select("_id", "_k", F.explode(F.transform("ns", lambda n: F.struct(n.alias("n"), F.get("lines", n).alias("line")))).alias("x"))
        .select("_id", "_k", "x.n", "x.line")
        .distinct()
    )
    fetched = stored(fetched, "candidates")

    def side(s: str) -> DataFrame:
        return fetched.select(F.col("_k").alias(f"{s}k"), F.col("n").alias(f"{s}n"), F.col("_id").alias(f"{s}id"), F.col("line").alias(f"{s}line"))

    both = pairs.join(side("a"), ["ak", "an"]).join(side("b"), ["bk", "bn"])
    later = F.struct("aid", "ak", "an") > F.struct("bid", "bk", "bn")
    both = both.select(F.when(later, F.col("ak")).otherwise(F.col("bk")).alias("_k"), F.when(later, F.col("an")).otherwise(F.col("bn")).alias("n"), "aline", "bline")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = ([t.encode() for t in texts_of(batch.column(c))] for c in ("aline", "bline"))
        near = pa.array(edit_distance_within(x, y, edits))
        return pa.RecordBatch.from_arrays([batch.column("_k").filter(near), batch.column("n").filter(near)], ["_k", "n"])

    crowded = to_blocks(hot.withColumn("line_id", F.xxhash64("_k", "n")), ["key"], "line_id", CHUNK, ROWS_PER_BIN).join(fetched, ["_k", "n"])
    shown = crowded.select("block", "key", "chunk", "first_chunk", "last_chunk", "mark", "_id", "_k", "n", "line")
    # Blocks are little data, but much work: several tasks per core.
    late = shown.repartition(4 * keyed.sparkSession.sparkContext.defaultParallelism, "block").groupBy("block").applyInArrow(_near_earlier(edits), "_k long, n int")
    gone = stored(arrow_stage(both, "_k long, n int", verify).unionByName(late).distinct(), "near")
    return firsts.join(gone, ["_k", "n"], "left_anti").groupBy("_k").agg(F.collect_list("n").alias("kept"))


def dedup_lines(docs: DataFrame, row_id: str = "doc_id", text: str = "text", edits: int = EDITS, least_bytes: int = LEAST_BYTES, counts: tuple[str, str] = ("n_lines", "n_removed"), short_repeats: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``text`` freed of repeated lines, and
    ``n_lines`` and ``n_removed`` (or the names in ``counts``).

    Documents are in the order of their id (null first, equal ids by text), lines
    in their own. A line of at least ``least_bytes`` bytes goes if an earlier one
    is equal or at most ``edits`` edits away, whether or not that one stays;
    shorter lines stay or, with ``short_repeats``, go if an earlier one is equal
    and they are not blank. A null text stays null and has one empty line. Rows equal
    in id and text count as one document and are treated alike. An empty table
    gives no rows. Columns of the names used here are kept apart.
    """
    own = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(row_id).alias("_id"), F.xxhash64(F.col(row_id), F.col(text)).alias("_k"), F.col(text).alias("_text"))
    verdicts = line_verdicts(keyed.select("_id", "_k", "_text"), edits, least_bytes, short_repeats)
    judged = keyed.select("_row", "_k").join(verdicts.hint("merge"), "_k", "left").select("_row", F.col(f"_row.`{text}`").alias("_text"), F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))

    def judged_line(line: str) -> bool:
        return len(line.encode()) >= least_bytes or short_repeats and re.search(_INK, line) is not None

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, lines_of, gone = [], [], []
        for t, kept in zip(batch.column("_text").to_pylist(), batch.column("kept").to_pylist()):
            lines = (t or "").split("\n")
            stay = set(kept)
            left = [x for i, x in enumerate(lines) if i in stay or not judged_line(x)]
            out.append(None if t is None else "\n".join(left))
            lines_of.append(len(lines))
            gone.append(len(lines) - len(left))
        row = batch.column("_row")
        return pa.RecordBatch.from_arrays([row, pa.array(out, pa.string()), pa.array(lines_of, pa.int64()), pa.array(gone, pa.int64())], ["_row", "_text", "n_lines", "n_removed"])

    row_type = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")).schema["_row"].dataType.simpleString()
    cleaned = arrow_stage(judged, f"_row {row_type}, _text string, n_lines long, n_removed long", clean)
    columns = [F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in own]
    return cleaned.select(*columns, F.col("n_lines").alias(counts[0]), F.col("n_removed").alias(counts[1]))
