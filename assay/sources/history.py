"""Run history as an append-only parquet table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assay.sources.naming import strip_private

# Stored columns and listing size.
SESSION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("col_count", T.LongType()),
        T.StructField("business_question", T.StringType()),
        T.StructField("problem_type", T.StringType()),
        T.StructField("plan_json", T.StringType()),
        T.StructField("results_json", T.StringType()),
        T.StructField("report_text", T.StringType()),
        T.StructField("model_performance_json", T.StringType()),
        T.StructField("run_date", T.DateType()),
    ]
)
LISTED = ("id", "created_at", "dataset_name", "row_count", "col_count", "business_question", "problem_type")
LIST_LIMIT = 5


def session_rows(runs: DataFrame) -> DataFrame:
    """Runs with plan, results and model columns, as stored rows.

    ``runs``: id, created_at (timestamp), dataset_name, row_count, col_count,
    business_question, report_text and the nested columns plan, results and
    model_performance. Private fields are dropped before they are written.
    """
    clean = strip_private(runs)
    return clean.select(
        "id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "dataset_name",
        F.col("row_count").cast("long"), F.col("col_count").cast("long"), "business_question",
        F.coalesce(F.col("plan.problem_type"), F.lit("descriptive")).alias("problem_type"),
        F.to_json("plan").alias("plan_json"), F.to_json("results").alias("results_json"), "report_text",
        F.to_json("model_performance").alias("model_performance_json"), F.to_date("created_at").alias("run_date"),
    )


def save_sessions(runs: DataFrame, path: str) -> None:
    """Append runs, one folder per day."""
    session_rows(runs).write.mode("append").partitionBy("run_date").parquet(path)


def new_session_id() -> str:
    return uuid.uuid4().hex


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The stored runs; an absent table is an empty one."""
    try:
        return spark.read.schema(SESSION_SCHEMA).parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], SESSION_SCHEMA)


def list_sessions(sessions: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The newest runs first; runs of the same second are ordered by id."""
    return sessions.select(*LISTED).orderBy(F.desc("created_at"), "id").limit(limit)


def load_session(sessions: DataFrame, session_id: str) -> DataFrame:
    """One run; JSON columns lose their suffix, unreadable JSON becomes an empty object."""
    found = sessions.where(F.col("id") == session_id)
    return parse_sessions(found)


def parse_sessions(sessions: DataFrame) -> DataFrame:
    blobs = ("plan_json", "results_json", "model_performance_json")
    empty = F.parse_json(F.lit("{}"))
    return sessions.select(
        *[c for c in sessions.columns if c not in blobs and c != "run_date"],
        *[F.coalesce(F.try_parse_json(F.col(c)), empty).alias(c.removesuffix("_json")) for c in blobs],
    )
