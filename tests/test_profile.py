import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.operators import profile, quantiles
from assay.settings import Settings


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_roles_and_shape(churn):
    p = profile.column_profile(churn, "churn").persist()
    rows = by_name(p)
    assert rows["contract_type"]["role"] == "categorical" and rows["churn"]["role"] == "numeric"
    d = profile.dataset_profile(p).first()
    assert d["rows"] == 400 and d["cols"] == 6 and d["has_datetime"] is False
    assert d["potential_target_columns"] == ["churn"]
    assert "monthly_charges" in [r["name"] for r in profile.target_columns(p, "substring").collect()]


def test_numbers_match_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"v": rng.gamma(2, 3, 500), "w": rng.normal(size=500)})
    pdf.loc[::7, "v"] = np.nan
    r = by_name(profile.column_profile(spark.createDataFrame(pdf)))["v"]
    v = pdf["v"].dropna()
    for got, want in [(r["mean"], v.mean()), (r["median"], v.median()), (r["std"], v.std()), (r["skew"], v.skew()), (r["q1"], v.quantile(0.25))]:
        assert got == pytest.approx(want, rel=1e-9)
    iqr = v.quantile(0.75) - v.quantile(0.25)
    outside = ((v < v.quantile(0.25) - 1.5 * iqr) | (v > v.quantile(0.75) + 1.5 * iqr)).sum()
    assert r["outlier_count"] == outside and r["null_count"] == pdf["v"].isna().sum()


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_tiny_tables(spark, n):
    df = spark.range(n).select(F.col("id").cast("double").alias("x"), F.lit(0.1).alias("c"), F.lit(None).cast("string").alias("e"))
    rows = by_name(profile.column_profile(df))
    assert rows["x"]["n_rows"] == n and rows["e"]["role"] == "categorical"
    if n == 0:
        assert rows["x"]["mean"] is None and rows["x"]["null_pct"] == 0.0
    else:
        assert rows["c"]["skew"] == 0.0 and rows["c"]["std"] == 0.0 and rows["c"]["outlier_count"] == 0


@pytest.mark.parametrize("distinct,role", [(50, "categorical"), (51, "text")])
def test_category_cap(spark, distinct, role):
    df = spark.range(204).select((F.col("id") % distinct).cast("string").alias("s"), "id")
    assert by_name(profile.column_profile(df))["s"]["role"] == role


def test_booleans_decimals_and_dates_have_their_role(spark):
    df = spark.createDataFrame(
        [(True, datetime.date(2024, 1, 1), 1), (None, datetime.date(2024, 2, 1), 2)], "b boolean, d date, i int"
    ).withColumn("dec", F.col("i").cast("decimal(10,2)"))
    rows = by_name(profile.column_profile(df))
    assert [rows[c]["role"] for c in ("b", "d", "dec")] == ["boolean", "datetime", "numeric"]
    assert rows["d"]["min_date"] == "2024-01-01" and [tuple(x) for x in rows["b"]["top_values"]] == [("true", 1)]


@pytest.mark.parametrize("good,coerced", [(71, True), (70, False)])
def test_dates_are_coerced_above_seventy_percent(spark, good, coerced):
    df = spark.range(100).select(
        F.when(F.col("id") < good, F.lit("2024-03-05")).otherwise("soon").alias("order_date"), F.lit("2024-03-05").alias("note")
    )
    out = profile.coerce_datetimes(df)
    assert (out.schema["order_date"].dataType.typeName() == "timestamp") is coerced
    assert out.schema["note"].dataType.typeName() == "string"


def test_high_null_share_is_strict(spark):
    df = spark.range(100).select(
        F.when(F.col("id") >= 20, F.col("id")).alias("at"), F.when(F.col("id") >= 21, F.col("id")).alias("over")
    )
    assert profile.dataset_profile(profile.column_profile(df)).first()["high_null_columns"] == ["over"]


@pytest.mark.parametrize("limit", [5, 10**6])
def test_both_quantile_ways_agree_with_numpy_on_skewed_data(spark, limit):
    """A third of the rows share one value; groups differ in size."""
    rng = np.random.default_rng(5)
    a = np.concatenate([np.full(1000, 7.25), rng.normal(size=2000) * 10])
    b = rng.exponential(size=37)
    pdf = pd.concat([pd.DataFrame({"g": "a", "value": a}), pd.DataFrame({"g": "b", "value": b})])
    df = spark.createDataFrame(pdf).repartition(6)
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, ["g"], "value", probs, Settings(direct_quantile_values=limit))
    rows = {r["g"]: [r[f"q{i}"] for i in range(len(probs))] for r in got.collect()}
    assert rows["a"] == pytest.approx(list(np.quantile(a, probs)), rel=1e-12)
    assert rows["b"] == pytest.approx(list(np.quantile(b, probs)), rel=1e-12)


def test_many_groups_take_the_ranked_way(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "_MAX_BRACKET_GROUPS", 2)
    df = spark.range(300).select((F.col("id") % 5).alias("g"), (F.col("id") * 1.5).alias("value"))
    got = quantiles.exact_quantiles(df, ["g"], "value", [0.3], Settings(direct_quantile_values=1))
    for r in got.collect():
        want = np.quantile([1.5 * i for i in range(300) if i % 5 == r["g"]], 0.3)
        assert r["q0"] == pytest.approx(want)


@pytest.mark.parametrize(
    "texts",
    [
        ["1/2/2023", "12/31/2023"], ["20230105", "20231231"], ["2023.01.05", "2023.12.31"], ["05-01-2023", "31-12-2023"], ["5 January 2023", "31 December 2023"],
        ["Jan 5 2023", "Dec 31 2023"], ["31/12/2023", "05/01/2023"], ["01/05/23", "12/31/23"], ["2023-01-05 10:00:00", "2023-12-31"],
    ],
)
def test_date_layouts(spark, texts):
    out = profile.coerce_datetimes(spark.createDataFrame([(t,) for t in texts], "order_date string"))
    assert out.schema["order_date"].dataType.typeName() == "timestamp"
    days = sorted((r[0].month, r[0].day) for r in out.collect())
    assert days[-1] == (12, 31) and days[0] in ((1, 2), (1, 5)) and len(days) == 2
