"""Exact interpolated quantiles at any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from assay.functions.columns import as_number
from assay.operators.running import running_totals
from assay.settings import DEFAULTS, Settings

_SKETCH_ACCURACY = 2000
_MAX_BRACKET_GROUPS = 10_000


def long_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) rows of the numeric columns, nulls left out."""
    wide = df.select(*[as_number(df, c).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "value").where(F.col("value").isNotNull())


def value_counts(long: DataFrame, groups: list[str], value: str = "value") -> DataFrame:
    """Distinct values with their counts; copies collapse before the shuffle."""
    return long.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))


def _names(probs: list[float]) -> list[str]:
    return [f"q{i}" for i in range(len(probs))]


def _direct(long: DataFrame, groups: list[str], value: str, probs: list[float]) -> DataFrame:
    at = F.array(*[F.lit(float(p)) for p in probs])
    counts = value_counts(long, groups, value)
    packed = counts.groupBy(*groups).agg(F.percentile(value, at, F.col("n")).alias("_q"))
    return packed.select(*groups, *[F.col("_q")[i].alias(q) for i, q in enumerate(_names(probs))])


def exact_quantiles(
    long: DataFrame,
    groups: list[str],
    value: str,
    probs: list[float],
    settings: Settings = DEFAULTS,
    distinct: int | None = None,
) -> DataFrame:
    """One row per group with columns q0, q1, ... for ``probs``.

    ``long`` has the group columns and a DOUBLE value. Groups whose distinct
    values fit the checked limit go through a value-count table. Otherwise a
    sketch first brackets each quantile, so that only the values inside the
    brackets are counted, range-sorted and ranked; a bracket that fails its
    rank check is opened to the whole range.
    """
    long = long.where(F.col(value).isNotNull())
    if distinct is None:
        per_group = long.groupBy(*groups).agg(F.approx_count_distinct(value, 0.02).alias("d"))
        distinct = per_group.agg(F.coalesce(F.max("d"), F.lit(0))).first()[0]
    if distinct <= settings.direct_quantile_values:
        return _direct(long, groups, value, probs)
    return _bracketed(long, groups, value, probs)


def _bracketed(long: DataFrame, groups: list[str], value: str, probs: list[float]) -> DataFrame:
    margin = 2.0 / _SKETCH_ACCURACY
    edges = []
    for p in probs:
        edges += [max(0.0, p - margin), min(1.0, p + margin)]
    at = F.array(*[F.lit(e) for e in edges])
    stats = long.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx(value, at, F.lit(_SKETCH_ACCURACY)).alias("_e"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
    )
    targets = stats.select(
        *groups,
        "_n",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("i"),
                        F.lit(float(p)).alias("p"),
                        (F.col("_min") if edges[2 * i] <= 0 else F.col("_e")[2 * i]).alias("lo"),
                        (F.col("_max") if edges[2 * i + 1] >= 1 else F.col("_e")[2 * i + 1]).alias("hi"),
                        F.col("_min").alias("all_lo"),
                        F.col("_max").alias("all_hi"),
                    )
                    for i, p in enumerate(probs)
                ]
            )
        ).alias("t"),
    ).select(*groups, "_n", "t.*")
    most = _MAX_BRACKET_GROUPS * len(probs)
    rows = targets.limit(most + 1).collect()
    if len(rows) > most:
        ranked = running_totals(value_counts(long, groups, value), [value], {"upto": F.col("n")}, groups)
        small = targets.select(*[F.col(g).alias(f"_t_{g}") for g in groups], "_n", "i", "p")
        on = F.lit(True)
        for g in groups:
            on = on & ranked[g].eqNullSafe(small[f"_t_{g}"])
        return _pick(ranked.join(small, on).withColumn("_below", F.lit(0).cast("long")), groups, value, len(probs))

    spark = long.sparkSession
    marks = spark.createDataFrame(rows, targets.schema)
    marks = _checked_marks(long, marks, groups, value)
    held = _with_marks(long, marks, groups).where(F.col(value).between(F.col("lo"), F.col("hi")))
    counts = held.groupBy(*groups, "i", "p", "_n", "_below", value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, [value], {"upto": F.col("n")}, [*groups, "i"])
    return _pick(ranked, groups, value, len(probs))


def _with_marks(long: DataFrame, marks: DataFrame, groups: list[str]) -> DataFrame:
    renamed = marks.select(*[F.col(c).alias(f"_m_{c}") if c in groups else F.col(c) for c in marks.columns])
    if not groups:
        one = renamed.agg(F.collect_list(F.struct(*renamed.columns)).alias("m")).first()
        packed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in m.asDict().items()]) for m in one["m"]])
        return long.withColumn("_m", F.explode(packed)).select(*long.columns, "_m.*")
    on = F.lit(True)
    for g in groups:
        on = on & long[g].eqNullSafe(renamed[f"_m_{g}"])
    return long.join(F.broadcast(renamed), on).drop(*[f"_m_{g}" for g in groups])


def _checked_marks(long: DataFrame, marks: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Count what lies below each bracket and open the brackets that miss."""
    keep = [*groups, "i", "p", "_n", "lo", "hi", "all_lo", "all_hi"]
    found = (
        _with_marks(long, marks, groups)
        .groupBy(*keep)
        .agg(
            F.count_if(F.col(value) < F.col("lo")).alias("_below"),
            F.count_if(F.col(value) <= F.col("hi")).alias("_upto"),
        )
    )
    first = F.floor(F.col("p") * (F.col("_n") - 1))
    last = F.ceil(F.col("p") * (F.col("_n") - 1))
    good = (F.col("_below") <= first) & (last < F.col("_upto"))
    found = found.select(
        *groups,
        "i",
        "p",
        "_n",
        F.when(good, F.col("lo")).otherwise(F.col("all_lo")).alias("lo"),
        F.when(good, F.col("hi")).otherwise(F.col("all_hi")).alias("hi"),
        F.when(good, F.col("_below")).otherwise(0).cast("long").alias("_below"),
    )
    return long.sparkSession.createDataFrame(found.collect(), found.schema)


def _pick(ranked: DataFrame, groups: list[str], value: str, n_probs: int) -> DataFrame:
    """Interpolate between the two values whose rank ranges hold the quantile."""
    at = F.col("p") * (F.col("_n") - 1)
    first, last = F.floor(at), F.ceil(at)
    hi = F.col("_below") + F.col("upto")
    lo = hi - F.col("n")
    near = ranked.where((lo <= last) & (hi > first)).groupBy(*groups, "i").agg(
        F.min(F.when((lo <= first) & (hi > first), F.col(value))).alias("a"),
        F.max(F.when((lo <= last) & (hi > last), F.col(value))).alias("b"),
        F.first(at - first).alias("w"),
    )
    est = F.col("a") + (F.col("b") - F.col("a")) * F.col("w")
    return near.groupBy(*groups).agg(
        *[F.max(F.when(F.col("i") == i, est)).alias(f"q{i}") for i in range(n_probs)]
    )


def column_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    settings: Settings = DEFAULTS,
    distinct: dict[str, int] | None = None,
) -> DataFrame:
    """Quantiles of several numeric columns: (column, q0, q1, ...)."""
    if not columns:
        schema = "column string, " + ", ".join(f"{q} double" for q in _names(probs))
        return df.sparkSession.createDataFrame([], schema)
    if distinct is None:
        return exact_quantiles(long_numbers(df, columns), ["column"], "value", probs, settings)
    # Columns with few values stay on the cheap way even next to a wide one.
    small = [c for c in columns if distinct[c] <= settings.direct_quantile_values]
    parts = [
        exact_quantiles(long_numbers(df, part), ["column"], "value", probs, settings, max(distinct[c] for c in part))
        for part in (small, [c for c in columns if c not in small])
        if part
    ]
    return reduce(DataFrame.unionByName, parts)
