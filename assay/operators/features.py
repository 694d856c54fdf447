"""Feature choice, preparation and folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from assay.functions.columns import clean_input, is_numeric, varies
from assay.functions.hashing import key_text, uniform
from assay.operators.profile import distinct_counts
from assay.operators.quantiles import column_quantiles
from assay.operators.running import running_totals
from assay.settings import DEFAULTS, Settings

# What makes an identifier, and the cap on category levels.
ID_MIN_ROWS = 20
ID_DISTINCT_SHARE = 0.95
MAX_LEVELS = 30
MIN_CLASS_ROWS = 5


def _takes_numbers(dt: T.DataType) -> bool:
    return is_numeric(dt) or isinstance(dt, T.BooleanType)


def feature_kinds(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(position, name, n, distinct_count, id_like, kind).

    kind is numeric, categorical or dropped: identifiers and text with more
    than 30 values are dropped.
    """
    df = clean_input(df)
    features = df.columns if features is None else features
    aggs = []
    for i, c in enumerate(features):
        x = F.col(f"`{c}`")
        whole = F.coalesce(F.bool_and(x % 1 == 0), F.lit(False)) if is_numeric(df.schema[c].dataType) else F.first(F.lit(False))
        aggs += [F.count(x).alias(f"n{i}"), whole.alias(f"w{i}")]
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("name"), F.col(f"n{i}").alias("n"), F.col(f"w{i}").alias("whole"),
                F.lit(c.lower() == "id" or c.lower().endswith("_id")).alias("id_name"),
                F.lit(_takes_numbers(df.schema[c].dataType)).alias("is_number"),
            )
            for i, c in enumerate(features)
        ]
    )
    facts = df.agg(*aggs).select(F.explode(cells).alias("c")).select("c.*")
    # One row per column on both sides.
    rows = distinct_counts(df, features).join(F.broadcast(facts), "name")
    id_like = (
        (F.col("n") >= ID_MIN_ROWS)
        & (F.col("distinct_count") >= ID_DISTINCT_SHARE * F.col("n"))
        & (F.col("whole") | F.col("id_name"))
    )
    kind = (
        F.when(id_like, "dropped")
        .when(F.col("is_number"), "numeric")
        .when(F.col("distinct_count") <= MAX_LEVELS, "categorical")
        .otherwise("dropped")
    )
    return rows.select("position", "name", "n", "distinct_count", id_like.alias("id_like"), kind.alias("kind"))


def split_features(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    rows = feature_kinds(df, features).orderBy("position").collect()
    return [r["name"] for r in rows if r["kind"] == "numeric"], [r["name"] for r in rows if r["kind"] == "categorical"]


@dataclass(frozen=True)
class Preparation:
    """What a training frame teaches the preparation step."""

    numeric: dict[str, tuple[float, float, float]]  # median, mean, population deviation
    categorical: dict[str, tuple[str, list[str]]]  # most frequent value, sorted levels

    def filled(self, name: str) -> Column:
        c = F.col(f"`{name}`")
        if name in self.numeric:
            return F.coalesce(c.cast("double"), F.lit(self.numeric[name][0]))
        return F.coalesce(c.cast("string"), F.lit(self.categorical[name][0]))

    def columns(self) -> list[Column]:
        out = []
        for name, (_, mean, spread) in self.numeric.items():
            out.append(((self.filled(name) - mean) / (spread or 1.0)).alias(name))
        for name, (_, levels) in self.categorical.items():
            out += [(self.filled(name) == v).cast("double").alias(f"{name}={v}") for v in levels]
        return out

    def vector(self) -> Column:
        return array_to_vector(F.array(*self.columns()))


def fit_preparation(
    df: DataFrame, numeric: list[str], categorical: list[str], settings: Settings = DEFAULTS
) -> Preparation:
    """Medians, means, deviations and levels; nulls take the median or the mode."""
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in numeric]) if numeric else None
    medians = (
        {r["column"]: r["q0"] for r in column_quantiles(numbers, numeric, [0.5], settings).collect()} if numeric else {}
    )
    known = {c: medians[c] for c in numeric if c in medians}
    moments: dict[str, tuple[float, float, float]] = {}
    if known:
        aggs = []
        for i, (c, median) in enumerate(known.items()):
            x = F.coalesce(F.col(f"`{c}`"), F.lit(median))
            aggs += [F.avg(x).alias(f"m{i}"), F.when(varies(x), F.stddev_pop(x)).otherwise(0.0).alias(f"s{i}")]
        row = numbers.agg(*aggs).first()
        moments = {c: (m, row[f"m{i}"], row[f"s{i}"]) for i, (c, m) in enumerate(known.items())}
    levels: dict[str, tuple[str, list[str]]] = {}
    if categorical:
        text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in categorical])
        # At most MAX_LEVELS values per column got through the feature choice.
        counts = (
            text.unpivot([], categorical, "column", "value")
            .where(F.col("value").isNotNull())
            .groupBy("column", "value")
            .count()
            .collect()
        )
        for c in categorical:
            mine = sorted((r["value"], r["count"]) for r in counts if r["column"] == c)
            if mine:
                levels[c] = (max(mine, key=lambda vc: vc[1])[0], [v for v, _ in mine])
    return Preparation(moments, levels)


def prepare_rows(
    df: DataFrame, target: str, features: list[str], key: list[str], settings: Settings = DEFAULTS
) -> DataFrame:
    """Rows with a target; an optional row budget draws a hash sample (off by default)."""
    df = clean_input(df)
    keep = list(dict.fromkeys([*key, *[f for f in features if f != target], target]))
    rows = df.select(*[F.col(f"`{c}`") for c in keep]).where(F.col(f"`{target}`").isNotNull())
    budget = settings.max_modeling_rows
    if budget is not None:
        n = rows.count()
        if n > budget:
            rows = rows.where(uniform(key_text(*key), f"sample:{settings.random_state}") < budget / n)
    return rows


def keep_frequent_classes(rows: DataFrame, target: str, least: int = MIN_CLASS_ROWS) -> DataFrame:
    """Drop the rows of classes with fewer than ``least`` rows."""
    counts = rows.groupBy(target).count()
    frequent = counts.where(F.col("count") >= least).select(target)
    return rows.join(frequent, target, "left_semi")


def fold_count(n: int, settings: Settings = DEFAULTS) -> int:
    return min(settings.cv_splits, max(2, n // 10))


def stratified_fold_count(smallest_class: int, settings: Settings = DEFAULTS) -> int:
    return max(2, min(settings.cv_splits, smallest_class))


def assign_folds(df: DataFrame, key: list[str], k: int, strata: str | None = None) -> DataFrame:
    """Add ``fold``: rows in hash order, dealt round-robin, per class if stratified.

    Sizes differ by at most one (per class). ``key`` must identify a row.
    """
    hashed = df.withColumn("_order", F.md5(key_text(*key))).withColumn("_tie", key_text(*key))
    numbered = running_totals(hashed, ["_order", "_tie"], {"idx": F.lit(1)}, [strata] if strata else [])
    return numbered.withColumn("fold", ((F.col("idx") - 1) % k).cast("int")).drop("_order", "_tie", "idx")
