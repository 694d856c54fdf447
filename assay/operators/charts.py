"""Chart-ready tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assay.functions.columns import as_number, clean_input
from assay.operators.correlation import correlation_matrix
from assay.operators.distribution import histogram
from assay.operators.quantiles import column_quantiles, exact_quantiles, long_numbers
from assay.settings import DEFAULTS, Settings

# Bins, bars and preview rows.
CHART_BINS = 30
CHART_BARS = 12
PREVIEW_ROWS = 10


def chart_histogram(df: DataFrame, column: str) -> DataFrame:
    return histogram(df, [column], CHART_BINS)


def box_table(df: DataFrame, columns: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Five numbers per column, and whiskers at the last values within 1.5 IQR."""
    df = clean_input(df)
    box = column_quantiles(df, columns, [0.0, 0.25, 0.5, 0.75, 1.0], settings)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col("value")
    # One row per column is broadcast.
    ends = (
        long_numbers(df, columns)
        .join(F.broadcast(box), "column")
        .groupBy("column")
        .agg(
            F.min(F.when(v >= F.col("q1") - reach, v)).alias("lower_whisker"),
            F.max(F.when(v <= F.col("q3") + reach, v)).alias("upper_whisker"),
        )
    )
    return box.join(ends, "column").select(
        "column", F.col("q0").alias("min"), F.col("q1").alias("q1"), F.col("q2").alias("median"),
        F.col("q3").alias("q3"), F.col("q4").alias("max"), "lower_whisker", "upper_whisker",
    )


def outlier_scatter(df: DataFrame, flagged: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """(key..., x, y, status) of the rows where both are set."""
    df = clean_input(df)
    points = df.select(*key, as_number(df, x).alias("x"), as_number(df, y).alias("y")).na.drop(subset=["x", "y"])
    marks = flagged.select(*key, "is_outlier")
    status = F.when(F.coalesce("is_outlier", F.lit(False)), "Outlier").otherwise("Normal")
    return points.join(marks, key, "left").select(*key, "x", "y", status.alias("status"))


def importance_bars(importance: DataFrame, k: int = CHART_BARS) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def fold_score_boxes(cv_scores: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Five numbers of the fold scores per model."""
    q = exact_quantiles(cv_scores.select("model", F.col("score").cast("double")), ["model"], "score", [0.0, 0.25, 0.5, 0.75, 1.0], settings)
    return q.toDF("model", "min", "q1", "median", "q3", "max")


def correlation_heatmap(df: DataFrame, columns: list[str]) -> DataFrame:
    """The correlation matrix with one column per table column."""
    matrix = correlation_matrix(df, columns)
    return matrix.groupBy("a").pivot("b", columns).agg(F.first("correlation"))


def results_header(plans: DataFrame, datasets: DataFrame, models: DataFrame) -> DataFrame:
    """(run_id, rows, cols, problem_type, metric, score): the figures above a report."""
    joined = plans.select("run_id", "problem_type").join(datasets.select("run_id", "rows", "cols"), "run_id").join(
        models.drop("problem_type"), "run_id", "left"
    )
    trained = F.coalesce("trained", F.lit(False))
    return joined.select(
        "run_id", "rows", "cols", "problem_type",
        F.when(trained & F.col("best_k").isNotNull(), F.lit("Clusters")).when(trained, F.col("metric_name")).alias("metric"),
        F.when(trained, F.coalesce(F.col("best_k").cast("double"), F.col("cv_mean"))).alias("score"),
    )


def preview(df: DataFrame, key: list[str], n: int = PREVIEW_ROWS) -> DataFrame:
    return df.orderBy(*key).limit(n)
