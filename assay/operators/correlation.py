"""Pairwise correlation with significance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from assay.functions.columns import as_number, batched, clean_input, numeric_columns, varies
from assay.functions.pvalues import correlation_p
from assay.functions.text import strength_label

PAIRS_PER_PASS = 100
SIGNIFICANT = 0.05


def pair_correlations(
    df: DataFrame, columns: list[str] | None = None, pairs: list[tuple[str, str]] | None = None
) -> DataFrame:
    """(pair, a, b, n, r) for every column pair over rows where both are set.

    A first pass finds means and null-free columns. Pairs without nulls then
    cost one sum of centred products each; pairs with nulls take the masked
    regression sums. Both work where ``corr`` would fail on a constant column,
    whose r is null here.
    """
    df = clean_input(df)
    columns = numeric_columns(df) if columns is None else columns
    if pairs is None:
        pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    schema = "pair int, a string, b string, n bigint, r double"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    used = list(dict.fromkeys(c for pair in pairs for c in pair))
    numbers = df.select(*[as_number(df, c).alias(c) for c in used])
    facts = _column_facts(numbers)
    parts = []
    for start, part in zip(range(0, len(pairs), PAIRS_PER_PASS), batched(pairs, PAIRS_PER_PASS)):
        aggs: dict[str, Column] = {}
        cells = []
        for i, (a, b) in enumerate(part):
            n, r = _pair_terms(i, a, b, facts, aggs)
            cells.append(
                F.struct(F.lit(start + i).alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b"), n.alias("n"), r.alias("r"))
            )
        one = numbers.agg(*[c.alias(name) for name, c in aggs.items()])
        parts.append(one.select(F.explode(F.array(*cells)).alias("c")).select("c.*"))
    return reduce(DataFrame.unionByName, parts)


def _column_facts(numbers: DataFrame) -> dict[str, dict]:
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(numbers.columns):
        x = F.col(f"`{c}`")
        aggs += [F.count(x).alias(f"f{i}"), F.avg(x).alias(f"m{i}"), varies(x).alias(f"v{i}")]
    row = numbers.agg(*aggs).first()
    return {
        c: {"n": row["n"], "full": row[f"f{i}"] == row["n"], "mean": row[f"m{i}"] or 0.0, "varies": bool(row[f"v{i}"])}
        for i, c in enumerate(numbers.columns)
    }


def _pair_terms(i: int, a: str, b: str, facts: dict, aggs: dict[str, Column]) -> tuple[Column, Column]:
    """Row count and r of a pair; the sums they need are added to ``aggs``."""
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    if facts[a]["full"] and facts[b]["full"]:
        n = F.lit(facts[a]["n"]).cast("long")
        if not (facts[a]["varies"] and facts[b]["varies"]):
            aggs.setdefault("n", F.count(F.lit(1)))
            return n, F.lit(None).cast("double")
        dx, dy = x - facts[a]["mean"], y - facts[b]["mean"]
        aggs[f"square {a}"], aggs[f"square {b}"] = F.sum(dx * dx), F.sum(dy * dy)
        aggs[f"xy{i}"] = F.sum(dx * dy)
        xx, yy = F.col(f"`square {a}`"), F.col(f"`square {b}`")
        ok = (xx > 0) & (yy > 0)
    else:
        aggs |= {
            f"n{i}": F.regr_count(x, y), f"xy{i}": F.regr_sxy(x, y), f"xx{i}": F.regr_syy(x, y), f"yy{i}": F.regr_sxx(x, y),
            f"ok{i}": varies(F.when(y.isNotNull(), x)) & varies(F.when(x.isNotNull(), y)),
        }
        ok = F.col(f"ok{i}")
        n, xx, yy = F.coalesce(f"n{i}", F.lit(0)).cast("long"), F.col(f"xx{i}"), F.col(f"yy{i}")
    r = F.try_divide(F.col(f"xy{i}"), F.sqrt(xx) * F.sqrt(yy))
    # An infinite value leaves r undefined; NaN counts as larger than any number.
    return n, F.when(ok & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def strongest_first(r: Column) -> list[Column]:
    return [F.abs(r).desc(), F.col("pair").asc()]


def top_correlations(df: DataFrame, n: int = 5) -> DataFrame:
    """The n strongest pairs by absolute rounded correlation, ties in column order."""
    pairs = pair_correlations(df).where((F.col("n") >= 2) & F.col("r").isNotNull())
    rounded = pairs.select("pair", "a", "b", F.round("r", 3).alias("correlation"))
    return rounded.orderBy(*strongest_first(F.col("correlation"))).limit(n).drop("pair")


def correlation_analysis(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every pair with at least 3 points: rank, r, p, strength label, significance."""
    pairs = pair_correlations(df, columns).where((F.col("n") >= 3) & F.col("r").isNotNull())
    p = correlation_p(F.col("r"), F.col("n"))
    scored = pairs.withColumn("_p", p).select(
        "pair", "a", "b", "n",
        F.round("r", 3).alias("correlation"), F.round("_p", 5).alias("p_value"),
        strength_label(F.col("r")).alias("strength"), (F.col("_p") < SIGNIFICANT).alias("significant"),
    )
    # One row per column pair: the window covers the result table, not the data.
    order = Window.orderBy(*strongest_first(F.col("correlation")))
    return scored.withColumn("rank", F.row_number().over(order)).drop("pair")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Full symmetric matrix in long form (a, b, correlation)."""
    df = clean_input(df)
    columns = numeric_columns(df) if columns is None else columns
    upper = pair_correlations(df, columns).select("a", "b", F.round("r", 3).alias("correlation"))
    if len(columns) < 2:
        upper = df.sparkSession.createDataFrame([], "a string, b string, correlation double")
    both = upper.select(
        F.explode(
            F.array(
                F.struct("a", "b", "correlation"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "correlation")
            )
        ).alias("c")
    ).select("c.*")
    spread = df.agg(*[varies(as_number(df, c)).alias(f"s{i}") for i, c in enumerate(columns)])
    diagonal = spread.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("a"), F.lit(c).alias("b"), F.when(F.col(f"s{i}"), 1.0).alias("correlation")
                    )
                    for i, c in enumerate(columns)
                ]
            )
        ).alias("c")
    ).select("c.*")
    return both.unionByName(diagonal)
