"""Removing repeated byte strings, over any number of documents.

Every string of ``length`` bytes belongs to the least hash of the ``GRAM``-byte
strings in it, so equal strings have equal keys. Documents are put into portions
that are written once; a portion tells every key's bucket only four bytes, and
learns which keys others have as well. Around those keys the portion cuts its
texts into segments (neighbouring strings of one key), and sends each different
segment once to the key's shard, with the smallest document it is in. A shard
sorts the strings of some keys at a time by their hashes and compares those of
one hash, or orders the suffixes of a large key's segments on disk
(``induced``), where neighbours with a common prefix of ``length`` are one
string; a segment learns where a smaller document has the same. Portions then
mark the bytes of their own documents.

No step needs a hot string's documents together: a portion speaks once for all
of its documents, however often a string is in them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from assay.llm.common import stored
from assay.llm.induced import BLOCK, Tape, scratch_array, sort_suffixes

#: Bytes of the strings that are hashed; a segment has at most so many strings of one key.
GRAM, MOST_STRINGS = 16, 128
#: Bytes of text in a portion and in a shard, keys in a bucket, suffix tuples in a task's memory.
PORTION_BYTES, SHARD_BYTES, BUCKET_KEYS, TUPLES = 4 << 20, 8 << 20, 1 << 20, 1 << 20
NO_ID = np.iinfo(np.int64).max
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_ZSTD = pa.Codec("zstd", compression_level=3)


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unpack(blob: bytes, *parts: tuple[str, int]) -> list[np.ndarray]:
    """Arrays of the given types and lengths, the last one up to the end."""
    raw = _ZSTD.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    out, at = [], 0
    for kind, n in parts:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def portions(docs: DataFrame, row_id: str, text: str, portion_bytes: int) -> DataFrame:
    """``portion, ids, sizes, blob``: the documents of a task, some at a time."""
    rows = docs.select(F.col(f"`{row_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def portion() -> pa.RecordBatch:
            sizes = [len(t) for t in texts]
            return pa.RecordBatch.from_pydict({
                "portion": pa.array([number], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "bytes": pa.array([sum(sizes)], pa.int64()), "blob": pa.array([_pack(np.frombuffer(b"".join(texts), np.uint8))], pa.binary()),
            })

        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(i), texts.append(t or b"")
                held += len(texts[-1]) + 16
                if held >= portion_bytes:
                    yield portion()
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield portion()

    return rows.mapInArrow(run, "portion long, ids array<long>, sizes array<long>, bytes long, blob binary")


def window_keys(data: np.ndarray, length: int) -> np.ndarray:
    """Key of the string of ``length`` bytes that starts at each place."""
    gram = min(GRAM, 1 << (length.bit_length() - 1))
    h = (data.astype(np.uint64) + _ODD[2]) * _ODD[0]
    step = 1
    while step < gram:
        h = h[:-step] * _ODD[1] + h[step:] * _ODD[3]
        h ^= h >> np.uint64(31)
        step *= 2
    h *= _ODD[0]
    h ^= h >> np.uint64(29)
    width, step = length - gram + 1, 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (width - step)], h[width - step :]) if width > step else h


class Portion:
    """The documents of a portion and their segments."""

    def __init__(self, ids: list, sizes: list, blob: bytes, length: int):
        self.names, self.length = ids, length
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        (self.data,) = _unpack(blob, ("u1", -1)) if self.sizes.sum() else (np.zeros(0, np.uint8),)
        if len(self.data) < length:
            self.start = self.doc = self.strings = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        keys = window_keys(self.data, length)
        room = np.repeat(self.ends, self.sizes)[: len(keys)] - np.arange(len(keys)) >= length
        start = np.flatnonzero(room)
        keys = keys[start]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (start[1:] != start[:-1] + 1)][: len(keys)]
        first = np.flatnonzero(new)
        runs = np.diff(np.r_[first, len(keys)])
        # Long runs (texts of one letter) are cut; all their parts keep the key.
        cuts = -(-runs // MOST_STRINGS)
        part = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        at = np.repeat(first, cuts) + part * MOST_STRINGS
        self.strings = np.minimum(MOST_STRINGS, np.repeat(first + runs, cuts) - at)
        self.start, self.key = start[at], keys[at]
        self.doc = np.searchsorted(self.ends, self.start, side="right")

    def distinct_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order, and whether several of the documents have them."""
        order = np.argsort(self.key, kind="stable")
        keys, ids = self.key[order], self.ids[self.doc[order]]
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        if not len(start):
            return keys, np.zeros(0, bool)
        return keys[start], np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)

    def segments(self, shared: np.ndarray, shards: int):
        """Of the segments with a key in ``shared``: their numbers, the number of
        the different text each one is, and for those text, shard and least id."""
        mine = np.flatnonzero(np.isin(self.key, shared))
        raw, known, which, example = self.data.tobytes(), {}, np.empty(len(mine), np.int64), []
        stop = self.start[mine] + self.strings[mine] + self.length - 1
        for i, (a, b) in enumerate(zip(self.start[mine].tolist(), stop.tolist())):
            piece = raw[a:b]
            at = known.get(piece)
            if at is None:
                at = known[piece] = len(example)
                example.append(i)
            which[i] = at
        least = np.full(len(example), NO_ID, np.int64)
        np.minimum.at(least, which, self.ids[self.doc[mine]])
        shard = ((self.key[mine[example]] >> np.uint64(20)) % np.uint64(shards)).astype(np.int64) if example else np.zeros(0, np.int64)
        return mine, which, list(known), shard, least


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(keys: np.ndarray, several: np.ndarray, buckets: int):
    """``(bucket, keys one document has, keys several have)``, low halves of the keys in order."""
    of = _bucket_of(keys, buckets)
    order = np.lexsort((keys.astype(np.uint32), of))
    of, low, several = of[order], keys[order].astype(np.uint32), several[order]
    start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
    for a, b in zip(start, np.r_[start[1:], len(of)]):
        yield int(of[a]), order[a:b], low[a:b][~several[a:b]], low[a:b][several[a:b]]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time: each holds the texts of a portion."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _portion_of(row: dict, length: int) -> Portion:
    return Portion(row["ids"], row["sizes"], row["blob"], length)


def _told_keys(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                out = list(_by_bucket(*_portion_of(row, length).distinct_keys(), buckets))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([o[0] for o in out], pa.int64()), "portion": pa.array([row["portion"]] * len(out), pa.int64()),
                    "once": pa.array([o[2].tobytes() for o in out], pa.binary()), "several": pa.array([o[3].tobytes() for o in out], pa.binary()),
                })

    return run


def _answer_keys(table: pa.Table) -> pa.Table:
    """For every portion of a bucket, which of its keys are in another one."""
    once, several = ([np.frombuffer(b, np.uint32) for b in table.column(c).to_pylist()] for c in ("once", "several"))
    sizes = [len(k) for k in once]
    keys, which, counts = np.unique(np.concatenate([*once, *several]), return_inverse=True, return_counts=True)
    shared = counts > 1
    shared[which[sum(sizes) :]] = True
    bits = np.split(shared[which[: sum(sizes)]], np.cumsum(sizes)[:-1])
    n_shared = [int(b.sum()) + len(s) for b, s in zip(bits, several)]
    return pa.table({"portion": table.column("portion"), "bucket": table.column("bucket"), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary()), "n_shared": pa.array(n_shared, pa.int64())})


def _shared_keys(portion: Portion, told: list, buckets: int) -> np.ndarray:
    keys, several = portion.distinct_keys()
    told = {t["bucket"]: t["bits"] for t in told}
    out = [keys[several]]
    for bucket, at, once, _ in _by_bucket(keys, several, buckets):
        bits = np.unpackbits(np.frombuffer(told[bucket], np.uint8), count=len(once)).astype(bool)
        out.append(keys[at[~several[at]][bits]])
    return np.concatenate(out)


def _send_segments(length: int, buckets: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                portion = _portion_of(row, length)
                _, _, texts, shard, least = portion.segments(_shared_keys(portion, row["told"] or [], buckets), shards)
                order = np.argsort(shard, kind="stable")
                start = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1]][: len(order)])
                out = []
                for part in np.split(order, start[1:]) if len(order) else []:
                    sizes = np.array([len(texts[i]) for i in part], np.uint16)
                    blob = _pack(least[part], sizes, np.frombuffer(b"".join(texts[i] for i in part), np.uint8))
                    out.append((int(shard[part[0]]), row["portion"], len(part), int(sizes.sum()), blob))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SENT.types)], schema=_SENT)

    return run


_SENT = pa.schema([("shard", pa.int64()), ("portion", pa.int64()), ("n", pa.int64()), ("bytes", pa.int64()), ("blob", pa.binary())])


def _group_lows(order: Tape, starts: np.ndarray, least: np.ndarray, length: int, n: int) -> np.ndarray:
    """For every place of a shard's text, the least document of the string there."""
    groups, held = Tape(np.int64), None
    for positions, common in order.blocks():
        owner = least[np.searchsorted(starts, positions, side="right") - 1]
        new = np.flatnonzero(common < length)
        if held is None or (len(new) and new[0] == 0):
            if held is not None:
                groups.append(np.array([held]))
            held = NO_ID
        lows = np.minimum.reduceat(owner, np.r_[0, new[new > 0]])
        lows[0] = min(lows[0], held)
        groups.append(lows[:-1])
        held = int(lows[-1])
    groups.append(np.array([held]))
    out, number = scratch_array(n, np.int64), -1
    for positions, common in order.blocks():
        group = number + np.cumsum((common < length) | ((np.arange(len(common)) == 0) & (number < 0)))
        first = max(0, int(group[0]))
        out[positions] = groups.read(first, int(group[-1]) + 1)[0][group - first]
        number = int(group[-1])
    return out


def _whole_keys(keys: np.ndarray, sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Neighbouring segments of whole keys, of ``limit`` bytes at most unless it is one key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    ends, upto = np.r_[starts[1:], len(keys)], np.cumsum(sizes)
    at, before = 0, 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(upto[ends - 1], before + limit, side="right")))
        yield slice(int(starts[at]), int(ends[to - 1]))
        before, at = int(upto[ends[to - 1] - 1]), to


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the string of ``length`` bytes that starts at each place."""
    h = (data.astype(np.uint64) + _ODD[2]) * _ODD[0]
    step = 1
    while 2 * step <= length:
        h = h[:-step] * _ODD[1] + h[step:] * _ODD[3]
        h ^= h >> np.uint64(31)
        step *= 2
    if step < length:  # two overlapping halves cover the string
        h = h[: step - length] * _ODD[1] + h[length - step :] * _ODD[3]
        h ^= h >> np.uint64(31)
    return h


def _runs_of(hit: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``segment, begin, length`` of neighbouring places of one segment."""
    if len(hit):
        segment = np.searchsorted(starts, hit, side="right") - 1
        first = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (segment[1:] != segment[:-1])])
        yield from zip(segment[first].tolist(), (hit[first] - starts[segment[first]]).tolist(), np.diff(np.r_[first, len(hit)]).tolist())


def _equal_strings(texts: list[bytes], least: np.ndarray, length: int) -> list | None:
    """Runs of strings that a smaller document has, by sorting hashes. Strings
    of one hash are compared byte by byte: if two differ, there is no result."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    strings = sizes - length + 1
    segment = np.repeat(np.arange(len(texts)), strings)
    place = np.arange(len(segment)) - np.repeat(np.cumsum(strings) - strings, strings) + starts[segment]
    h = string_hashes(data, length)[place]
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.r_[True, h[1:] != h[:-1]]
    del h
    a, b = place[order[:-1]][~new[1:]], place[order[1:]][~new[1:]]
    width = min(8, 1 << (length.bit_length() - 1))
    words = np.ndarray((len(data) - width + 1,), f"<u{width}", data, 0, (1,))  # the bytes from each place on
    for at in [*range(0, length - width, width), length - width]:
        if (words[a + at] != words[b + at]).any():
            return None
    first = np.flatnonzero(new)
    lows = np.repeat(np.minimum.reduceat(least[segment[order]], first), np.diff(np.r_[first, len(order)]))
    hit = np.sort(place[order[lows < least[segment[order]]]])
    return list(_runs_of(hit, starts))


def _ordered_strings(texts: list[bytes], low: np.ndarray, length: int, limit: int) -> Iterator[tuple[int, int, int]]:
    """The same by suffix order in scratch files, for keys of any size."""
    sizes = np.array([len(t) for t in texts])
    starts = scratch_array(len(texts) + 1, np.int64)
    starts[:-1], n = np.cumsum(sizes + 1) - sizes - 1, int(sizes.sum()) + len(texts) + 1
    starts[-1], least = n - 1, np.r_[low, NO_ID]
    # Symbols: 0 the end, 1 between segments, 2 and more the bytes of the text, none of which is above 253
    # (255 between the texts becomes 1).
    text = scratch_array(n + length, np.uint8)
    for a in range(0, len(texts), 1 << 14):
        joined = np.frombuffer(b"\xff".join(texts[a : a + (1 << 14)]) + b"\xff", np.uint8) + np.uint8(2)
        text[starts[a] : starts[a] + len(joined)] = joined
    text[n - 1] = 0
    lows = _group_lows(sort_suffixes(text, n, limit, length), starts, least, length, n)
    for a in range(0, n - 1, BLOCK):
        at = np.arange(a, min(a + BLOCK, n - 1))
        segment = np.searchsorted(starts, at, side="right") - 1
        yield from _runs_of(at[(starts[segment + 1] - 1 - at >= length) & (lows[at] < least[segment])], starts)


def _order_shard(length: int, limit: int):
    """Tells the portions of a shard which strings of their segments a smaller
    document has.

    Equal segments count once, with the smallest document of all. Only strings
    of one key can be equal, so strings are compared where a key has several
    segments, some keys at a time: by their hashes, or by suffix order where a
    key has more than ``limit`` bytes or a hash has two strings.
    """

    def run(table: pa.Table) -> pa.Table:
        sent = [r for r in zip(*(table.column(c).to_pylist() for c in ("portion", "shard", "n", "bytes", "blob")))]
        known: dict[bytes, int] = {}
        which, least_of = [], []
        for _, _, k, size, blob in sent:
            low, sizes, data = _unpack(blob, ("<i8", k), ("<u2", k), ("u1", size))
            raw, ends = data.tobytes(), np.cumsum(sizes.astype(np.int64)).tolist()
            which.append(np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip([0, *ends[:-1]], ends)]))
            least_of.append(low)
        low = np.full(len(known), NO_ID, np.int64)
        np.minimum.at(low, np.concatenate(which), np.concatenate(least_of))
        texts = list(known)
        del known
        _, of_key, several = np.unique(_first_keys(texts, length), return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(several[of_key] > 1)
        mixed = mixed[np.argsort(of_key[mixed], kind="stable")]
        runs: dict[int, list[tuple[int, int]]] = {}
        for part in _whole_keys(of_key[mixed], np.array([len(texts[i]) for i in mixed], np.int64), limit):
            some = mixed[part]
            size = sum(len(texts[i]) for i in some)
            found = _equal_strings([texts[i] for i in some], low[some], length) if size <= limit else None
            for i, begin, long in _ordered_strings([texts[i] for i in some], low[some], length, limit) if found is None else found:
                runs.setdefault(int(some[i]), []).append((begin, long))

        out = []
        for (portion, shard, k, _, _), text_of, own in zip(sent, which, least_of):
            whole = np.flatnonzero(low[text_of] < own)
            found = [(i, 0, len(texts[text_of[i]]) - length + 1) for i in whole.tolist()]
            found += [(i, b, r) for i in np.flatnonzero(low[text_of] == own).tolist() for b, r in runs.get(int(text_of[i]), ())]
            if found:
                segment, begin, long = (np.array(x) for x in zip(*found))
                out.append((portion, shard, len(found), _pack(segment.astype(np.uint32), begin.astype(np.uint8), long.astype(np.uint8))))
        schema = pa.schema([("portion", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    return run


def _first_keys(texts: list[bytes], length: int) -> np.ndarray:
    """Key of every segment, which is that of its first string."""
    out = np.empty(len(texts), np.uint64)
    for a in range(0, len(texts), 1 << 14):
        part = b"".join(t[:length] for t in texts[a : a + (1 << 14)])
        out[a : a + (1 << 14)] = window_keys(np.frombuffer(part, np.uint8), length)[::length]
    return out


def _mark(length: int, buckets: int, shards: int, with_text: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                p = _portion_of(row, length)
                mine, which, texts, shard, least = p.segments(_shared_keys(p, row["told"] or [], buckets), shards)
                change = np.zeros(len(p.data) + 1, np.int64)

                def cover(start, stop):
                    np.add.at(change, start, 1)
                    np.add.at(change, stop, -1)

                start, ids = p.start[mine], p.ids[p.doc[mine]]
                later = ids > least[which]
                cover(start[later], start[later] + p.strings[mine][later] + length - 1)
                firsts = np.flatnonzero(~later)
                firsts = firsts[np.argsort(which[firsts], kind="stable")]
                bounds = np.searchsorted(which[firsts], np.arange(len(texts) + 1))
                order = np.argsort(shard, kind="stable")
                shard_start = dict(zip(*(x.tolist() for x in np.unique(shard[order], return_index=True)))) if len(order) else {}
                for reply in row["replies"] or []:
                    k = reply["n"]
                    segment, begin, runs = _unpack(reply["blob"], ("<u4", k), ("u1", k), ("u1", k))
                    of = order[shard_start[reply["shard"]] + segment.astype(np.int64)]
                    copies = bounds[of + 1] - bounds[of]
                    flat = np.repeat(bounds[of], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                    at = start[firsts[flat]] + np.repeat(begin.astype(np.int64), copies)
                    cover(at, at + np.repeat(runs.astype(np.int64), copies) + length - 1)
                gone = np.cumsum(change[:-1]) > 0
                begins = gone & ~np.r_[False, gone[:-1]]
                begins[p.ends[:-1][p.ends[:-1] < len(gone)]] |= gone[p.ends[:-1][p.ends[:-1] < len(gone)]]
                removed, spans = (np.r_[0, np.cumsum(x)] for x in (gone, begins))
                edges = np.r_[0, p.ends]
                kept = [p.data[a:b][~gone[a:b]].tobytes() for a, b in zip(edges[:-1], edges[1:])]
                columns = [p.names, p.sizes, removed[edges[1:]] - removed[edges[:-1]], spans[edges[1:]] - spans[edges[:-1]], [hashlib.sha256(t).hexdigest() for t in kept]]
                if with_text:
                    columns.append(kept)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def remove_repeats(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", length: int = 50, with_text: bool = False,
    portion_bytes: int = PORTION_BYTES, shard_bytes: int = SHARD_BYTES, bucket_keys: int = BUCKET_KEYS, tuples: int = TUPLES,
) -> DataFrame:
    """``row_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for,
    the bytes ``kept``.

    A byte goes if a string of ``length`` bytes (UTF-8) that covers it also
    starts in a row with a smaller id; strings are those of the input and lie in
    one text. A null text is empty. Rows with the same id do not act on each
    other; a null id counts as larger than every other. Every row is returned,
    repeated ones each; an empty table gives no rows; other columns are not
    read. Ids are integers.
    """
    if not 2 <= length <= 120:
        raise ValueError("length must lie between 2 and 120 bytes")
    table = stored(portions(docs, row_id, text, portion_bytes), "portions")
    total = table.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = 1 + 2 * int(total) // (max(2, length - GRAM + 2) * bucket_keys)
    told = table.mapInArrow(_told_keys(length, buckets), "bucket long, portion long, once binary, several binary")
    answers = stored(told.groupBy("bucket").applyInArrow(_answer_keys, "portion long, bucket long, bits binary, n_shared long"), "shared")
    n_shared = answers.agg(F.coalesce(F.sum("n_shared"), F.lit(0))).first()[0]
    # A key has about one segment a portion, of some two strings' length.
    shards = 1 + int(n_shared) * (length + MOST_STRINGS // 6) // shard_bytes
    of_portion = answers.groupBy("portion").agg(F.collect_list(F.struct("bucket", "bits")).alias("told"))
    known = table.join(of_portion, "portion", "left")
    sent = known.mapInArrow(_send_segments(length, buckets, shards), "shard long, portion long, n long, bytes long, blob binary")
    replies = sent.groupBy("shard").applyInArrow(_order_shard(length, tuples), "portion long, shard long, n long, blob binary")
    replies = replies.groupBy("portion").agg(F.collect_list(F.struct("shard", "n", "blob")).alias("replies"))
    fields = [("_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    schema = pa.schema(fields + ([("kept", pa.binary())] if with_text else []))
    marked = known.join(replies, "portion", "left").mapInArrow(_mark(length, buckets, shards, with_text, schema), ddl)
    return marked.withColumnRenamed("_id", row_id)
