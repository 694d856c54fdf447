"""From raw documents to packed sequences: quality rules, line dedup, SimHash
near-dedup, secret redaction, packing. Each stage works on all rows and columns
that the one before it kept; its result is written and read back, after which
the next stage removes the working tables of the one before."""

from __future__ import annotations

import functools
import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assay.llm import lines, packing, quality, secrets, simhash  # noqa: E402
from assay.llm.catalog import table, tokenizer_file  # noqa: E402
from assay.functions.lineage import shared_path  # noqa: E402
from assay.llm.common import drop_working_tables  # noqa: E402


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars``, where the table has it, follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, the others stay as they are."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, short ones where they are equal. So does a document that lost lines and has none left
    but blank ones."""
    removed = "_" * max(map(len, docs.columns)) + "_removed"  # a name that no column has
    cleaned = lines.dedup_lines(docs, counts=(f"{removed}_of", removed), short_repeats=True)
    own = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = cleaned.where((F.col(removed) == 0) | own)
    return _with_length(kept.select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.keep_one(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced, every document stays."""
    return _with_length(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_file("byte_bpe_50k.json"))


def _stage(work):
    """A stage's input has been written by then, so that the working tables
    behind it are no longer needed."""

    @functools.wraps(work)
    def start(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_working_tables(spark, docs)
        return work(spark, docs, sf_dir)

    return start


STAGES = [
    ("quality rules", _stage(quality_rules)), ("line dedup", _stage(line_dedup)), ("simhash near-dedup", _stage(near_dedup)),
    ("secret scan", _stage(secret_redaction)), ("packing", _stage(pack)),
]
#: Packing is not expressible in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        result, path = stage(spark, docs, sf_dir), shared_path(spark, "stage")
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    drop_working_tables(spark)
    return docs
