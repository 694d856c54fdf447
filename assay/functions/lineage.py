"""Cutting lineage through reliable storage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. A session in one process (a local
    test) that has none gets a folder of its own; on a cluster that is an error,
    as executors do not share the driver's folders."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="assay-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and go on from there."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a working table in the shared checkpoint folder."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a working table of ``shared_path`` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame, rows: int, small: int = 5_000_000) -> DataFrame:
    """All cores for heavy per-row work on a small table, which one file may
    have put into a single partition; a large table keeps its partitions."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if rows < small else df


def fitted(df: DataFrame, rows: int, per_partition: int = 50_000) -> DataFrame:
    """Few partitions for a small table, so that iterative jobs stay short."""
    wanted = max(1, rows // per_partition)
    return df.coalesce(wanted) if wanted < df.sparkSession.sparkContext.defaultParallelism else df
