"""Comparing rows that share a key, in bounded blocks and without emitting pairs.

Rows with a common key are compared inside tasks with numpy. Keys with few rows
are put together into bins; a key with more than ``chunk`` rows is cut into
chunks, and every pair of chunks is a block of its own, so that no task ever
holds a whole hot group. What leaves a block is linear in its rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from assay.llm.common import stored


def to_blocks(postings: DataFrame, keys: list[str], row_id: str, chunk: int, rows_per_bin: int) -> DataFrame:
    """Rows of ``postings`` whose key occurs at least twice, each with the
    ``block`` (long) it is compared in, the ``first_chunk`` and ``last_chunk``
    of that block and its own ``chunk``. Rows of hot keys appear once per
    partner chunk."""
    counts = stored(postings.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1"), "keys")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    bins = max(1, int(total) // rows_per_bin)
    chunks = F.ceil(F.col("_n") / F.lit(chunk)).cast("int")
    placed = (
        postings.join(counts, keys)
        .withColumn("_c", chunks)
        .withColumn("chunk", F.pmod(F.xxhash64(row_id), F.col("_c")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
        .withColumn("first_chunk", F.least("chunk", "_other"))
        .withColumn("last_chunk", F.greatest("chunk", "_other"))
    )
    block = F.when(F.col("_c") == 1, F.pmod(F.xxhash64(*keys), F.lit(bins))).otherwise(
        F.xxhash64(*keys, "first_chunk", "last_chunk").bitwiseOR(F.lit(-(2**63)))
    )
    return placed.withColumn("block", block).drop("_n", "_c", "_other")


def pairs_in_block(keys: np.ndarray, chunk: np.ndarray, first: np.ndarray, last: np.ndarray, visit: Callable) -> None:
    """Call ``visit(i, j)`` with arrays of positions of rows that share a key
    and meet in this block: rows of one chunk among themselves in the block
    (c, c), rows of two chunks across in (c, d)."""
    if not len(keys):
        return
    order = np.lexsort((chunk, last, first, keys))
    k, c, f, l = keys[order], chunk[order], first[order], last[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (f[1:] != f[:-1]) | (l[1:] != l[:-1])]
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], len(k)]
    end_of = np.repeat(ends, ends - starts)
    here = np.arange(len(k))
    step = 1
    while True:
        here = here[here + step < end_of[here]]
        if not len(here):
            return
        there = here + step
        meet = (f[here] == l[here]) | (c[here] != c[there])
        if meet.any():
            visit(order[here[meet]], order[there[meet]])
        step += 1


def by_block(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy("block").applyInPandas(fn, schema)
