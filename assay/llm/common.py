"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import threading

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assay.functions.lineage import shared_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_WORKING = threading.local()


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a working table to the session's shared checkpoint folder and read
    it back: later stages survive the loss of any executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    _WORKING.__dict__.setdefault("paths", []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_working_tables(spark: SparkSession, but_for: DataFrame | None = None) -> None:
    """Remove the working tables this thread has stored so far, but for those
    that ``but_for`` still reads. Other results of them must have been written."""
    paths, _WORKING.paths = _WORKING.__dict__.get("paths", []), []
    read = {part for file in (but_for.inputFiles() if but_for is not None and paths else []) for part in file.split("/")}
    for path in paths:
        if path.rsplit("/", 1)[-1] in read:
            _WORKING.paths.append(path)
        else:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose ``column`` holds about ``most`` bytes, or one row that holds more."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff((np.cumsum(sizes, dtype=np.int64) - sizes) // most, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def arrow_stage(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str | None = None, most: int = 0) -> DataFrame:
    """Apply ``step`` to every Arrow batch of the frame, or to parts whose
    ``column`` holds about ``most`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, most) if column else batches:
            if batch.num_rows:
                out = step(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null counts as the empty text."""
    return [t if t is not None else "" for t in column.to_pylist()]


def local_roots(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``size`` positions over links."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new
