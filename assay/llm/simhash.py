"""SimHash near-duplicates by pigeonhole blocks.

The fingerprint's 64 bits are cut into ``blocks`` pieces. Two fingerprints at
``max_bits`` or fewer differing bits agree in at least ``blocks - max_bits``
whole pieces, so every combination of that many pieces is a join key under
which close pairs must meet; the Hamming distance then decides.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from assay.llm.blocks import by_block, pairs_in_block, to_blocks
from assay.llm.common import arrow_stage, local_roots, stored, texts_of
from assay.llm.graph import components

_SHINGLES_AT_ONCE = 1 << 16


def simhash(text: str, shingle_words: int, seed: int) -> int:
    """Fingerprint of a whole text; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - shingle_words + 1].tolist()
    end = end[shingle_words - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(start), _SHINGLES_AT_ONCE):
        part = slice(at, at + _SHINGLES_AT_ONCE)
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(start[part], end[part])], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(start)).tobytes(), "big")


def fingerprints(docs: DataFrame, columns: list[str], text: str = "text", shingle_words: int = 4, seed: int = 42) -> DataFrame:
    """``columns`` and ``fp`` (the fingerprint's bits as a signed long) of every row."""
    kept = docs.select(*columns, F.col(text).alias("_text"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([simhash(t, shingle_words, seed) for t in texts_of(batch.column("_text"))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(fps)], [*columns, "fp"])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["fp bigint"])
    return arrow_stage(kept, fields, step)


def block_keys(fp: Column, blocks: int, max_bits: int) -> Column:
    """Array of one long per combination of ``blocks - max_bits`` pieces: the
    pieces' bits in place, mixed with the combination's number."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        mask = sum(masks[i] for i in chosen)
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def _linked(max_bits: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy(np.int64)
        ids, place = np.unique(fp, return_inverse=True)
        bits = ids.view(np.uint64)
        left, right = [], []

        def visit(i: np.ndarray, j: np.ndarray) -> None:
            a, b = place[i], place[j]
            near = np.bitwise_count(bits[a] ^ bits[b]) <= max_bits
            left.append(a[near])
            right.append(b[near])

        pairs_in_block(rows["key"].to_numpy(), rows["chunk"].to_numpy(), rows["first_chunk"].to_numpy(), rows["last_chunk"].to_numpy(), visit)
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        root = local_roots(len(ids), a, b)
        moved = root != np.arange(len(ids))
        return pd.DataFrame({"x": ids[moved], "y": ids[root[moved]]})

    return run


def fingerprint_components(fps: DataFrame, max_bits: int = 4, blocks: int = 6, chunk: int = 1024, rows_per_bin: int = 20_000) -> DataFrame:
    """``(fp, group)`` for every distinct fingerprint of ``fps`` that links with
    another one; ``group`` names its component. Every link is found: a block
    gives a spanning forest of its links, which leaves components unchanged."""
    distinct = fps.select("fp").distinct()
    postings = distinct.select("fp", F.explode(block_keys(F.col("fp"), blocks, max_bits)).alias("key"))
    blocked = to_blocks(postings, ["key"], "fp", chunk, rows_per_bin)
    edges = by_block(blocked.select("block", "key", "fp", "chunk", "first_chunk", "last_chunk"), _linked(max_bits), "x long, y long")
    return components(edges, "x", "y").select(F.col("node").alias("fp"), F.col("component_id").alias("group"))


def near_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text", shingle_words: int = 4, max_bits: int = 4, blocks: int = 6, seed: int = 42) -> DataFrame:
    """``row_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest id reachable over fingerprints at ``max_bits`` or fewer bits.

    A null or wordless text has fingerprint zero and links like any other. Rows
    that repeat an id are all returned. A row without an id gets a component
    but never names it; a component without any id is null. An empty table
    gives no rows. Other columns are not read.
    """
    marked = stored(fingerprints(docs.select(F.col(row_id).alias("_id"), F.col(text).alias("_t")), ["_id"], "_t", shingle_words, seed), "fingerprints")
    lowest = marked.groupBy("fp").agg(F.min("_id").alias("low"))
    groups = fingerprint_components(marked, max_bits, blocks)
    classes = lowest.join(groups, "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    named = classes.join(classes.groupBy("group").agg(F.min("low").alias("component_id")), "group").select("fp", "component_id")
    named = stored(named, "classes")
    return marked.join(named, "fp").select(
        F.col("_id").alias(row_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, row_id: str = "doc_id", text: str = "text", shingle_words: int = 5, max_bits: int = 4, blocks: int = 6, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of every group the row with
    the smallest id stays (null ids last; of equal ids any one), with all its
    columns. Groups are those of :func:`near_duplicates`."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(row_id).alias("_id"), F.col(text).alias("_t"))
    marked = fingerprints(rows, ["_row", "_id"], "_t", shingle_words, seed)
    # A row's number is written with it, so every later job sees the same one.
    marked = stored(marked.withColumn("_uid", F.monotonically_increasing_id()), "fingerprints")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_uid").alias("uid"))).alias("first")
    lowest = marked.groupBy("fp").agg(first, F.count("*").alias("rows"))
    classes = lowest.join(fingerprint_components(marked, max_bits, blocks), "fp", "left").where("rows > 1 or group is not null").withColumn("group", F.coalesce("group", "fp"))
    kept = classes.groupBy("group").agg(F.min("first").alias("first")).select("group", F.col("first.uid").alias("keep"))
    kept = stored(classes.select("fp", "group").join(kept, "group").select("fp", "keep"), "kept")
    # What goes is little beside what stays: as long as it is small, no text moves.
    gone = stored(marked.select("_uid", "fp").join(kept, "fp").where("_uid <> keep").select("_uid"), "gone")
    return marked.join(gone, "_uid", "left_anti").select("_row.*")
