import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.operators import charts, confidence, correlation, distribution, outliers, segments, trend
from assay.operators.running import running_totals
from assay.settings import Settings


def pairs(df, *a):
    return {(r["a"], r["b"]): r for r in correlation.correlation_analysis(df, *a).collect()}


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    pdf = pd.DataFrame({"x": x, "y": 0.5 * x + rng.normal(size=300), "same": x, "flat": 0.1, "gap": rng.normal(size=300)})
    pdf.loc[::3, "gap"] = np.nan
    return pdf, spark.createDataFrame(pdf)


def test_correlations_match_pandas_pairwise(mixed):
    pdf, df = mixed
    got = pairs(df)
    want = pdf.corr()
    assert not any("flat" in k for k in got)
    for (a, b), r in got.items():
        assert r["correlation"] == pytest.approx(round(want.loc[a, b], 3), abs=1e-3)
    assert got[("x", "same")]["p_value"] == 0.0 and got[("x", "same")]["rank"] == 1
    assert got[("x", "gap")]["n"] == 200


def test_fewer_than_three_points_or_columns_give_no_pair(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 1.0, 3.0), (3.0, 5.0, 4.0)], "a double, b double, c double")
    assert set(pairs(df)) == {("a", "b")}
    assert correlation.correlation_analysis(df.select("a")).count() == 0
    assert len(correlation.top_correlations(df).collect()) == 3


def test_matrix_is_symmetric_with_a_unit_diagonal(mixed):
    _, df = mixed
    rows = {(r["a"], r["b"]): r["correlation"] for r in correlation.correlation_matrix(df, ["x", "y", "flat"]).collect()}
    assert len(rows) == 9 and rows[("x", "y")] == rows[("y", "x")]
    assert rows[("x", "x")] == 1.0 and rows[("flat", "flat")] is None and rows[("x", "flat")] is None


def test_pair_batches_do_not_change_the_result(mixed, monkeypatch):
    _, df = mixed
    want = pairs(df)
    monkeypatch.setattr(correlation, "PAIRS_PER_PASS", 2)
    assert pairs(df) == want


def test_moments_match_pandas_and_small_columns_are_left_out(spark):
    rng = np.random.default_rng(2)
    v = rng.gamma(1.5, 2, 60)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "few": [1.0] * 7 + [np.nan] * 53}))
    rows = {r["column"]: r for r in distribution.moments(df).collect()}
    s = pd.Series(v)
    assert set(rows) == {"v"}
    assert rows["v"]["skew"] == pytest.approx(s.skew()) and rows["v"]["kurtosis"] == pytest.approx(s.kurt())


def test_shapiro_wilk_textbook_sample(spark):
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    r = distribution.normality_small(spark.createDataFrame([(float(v),) for v in x], "x double")).first()
    assert r["w"] == pytest.approx(0.78881, abs=1e-5) and r["normal_p"] == pytest.approx(0.0067038, abs=1e-6)


@pytest.mark.parametrize("n", [8, 11, 12, 200])
def test_shapiro_wilk_accepts_normal_scores_and_rejects_a_spike(spark, n):
    from statistics import NormalDist

    scores = [NormalDist().inv_cdf((i + 0.625) / (n + 0.25)) for i in range(n)]
    df = spark.createDataFrame([(v, 0.0 if i else 1e6, 3.0) for i, v in enumerate(scores)], "good double, spike double, flat double")
    rows = {r["column"]: r for r in distribution.normality_small(df).collect()}
    assert set(rows) == {"good", "spike"}
    assert rows["good"]["normal_p"] > 0.9 and rows["spike"]["normal_p"] < 0.001


def test_the_test_changes_at_five_thousand_values(spark):
    df = spark.range(5000).select(F.when(F.col("id") > 0, F.randn(3)).alias("under"), F.randn(4).alias("at"))
    assert [r["column"] for r in distribution.normality_small(df).collect()] == ["under"]
    assert [r["column"] for r in distribution.normality_large(df).collect()] == ["at"]


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "flat": 2.0}))
    rows = distribution.histogram(df, ["v", "flat"]).orderBy("column", "bin").collect()
    counts, edges = np.histogram(v, bins=20)
    got = [r for r in rows if r["column"] == "v"]
    assert [r["n"] for r in got] == counts.tolist() and got[0]["lower_edge"] == round(edges[0], 4)
    flat = [r for r in rows if r["column"] == "flat"]
    assert sum(r["n"] for r in flat) == 500 and flat[0]["lower_edge"] == 1.5 and flat[-1]["upper_edge"] == 2.5


def test_running_totals_spread_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), "id")
    out = running_totals(df.repartition(5), ["id"], {"n": F.lit(1), "sum_id": F.col("id")}, ["g"])
    pdf = out.toPandas().sort_values(["g", "id"])
    want = pdf.groupby("g")["id"]
    assert (pdf["n"] == want.cumcount() + 1).all() and np.allclose(pdf["sum_id"], want.cumsum())
    assert len(pdf) == 3000


def test_running_totals_with_a_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, id int")
    got = {(r["g"], r["id"]): r["n"] for r in running_totals(df, ["id"], {"n": F.lit(1)}, ["g"]).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", 3): 1}


@pytest.mark.parametrize("n", [12, 31, 200])
def test_moving_average_matches_pandas(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"key": np.arange(n), "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(n) // 3, "D"), "value": rng.normal(size=n) * 100})
    df = spark.createDataFrame(pdf).repartition(4)
    got = trend.moving_average(df, "ts", "value", "key").orderBy("idx").toPandas()
    w = max(3, n // 10)
    ordered = pdf.sort_values(["ts", "key"])["value"].reset_index(drop=True)
    assert np.allclose(got["value"], ordered) and list(got["idx"]) == list(range(n))
    assert np.allclose(got["trend"], ordered.rolling(w, center=True, min_periods=1).mean())
    s = trend.trend_summary(trend.moving_average(df, "ts", "value", "key")).first()
    slope = np.polyfit(np.arange(n), ordered, 1)[0]
    rest = ordered - ordered.rolling(w, center=True, min_periods=1).mean()
    assert s["slope"] == pytest.approx(slope, abs=1e-6)
    assert s["structure_strength"] == pytest.approx(max(0, 1 - rest.var() / ordered.var()), abs=1e-3)


def test_trend_needs_twelve_points_and_survives_bad_values(spark):
    rows = [(f"2024-01-{i:02d}", str(i), i) for i in range(1, 12)] + [("soon", "1", 99), ("2024-02-01", "many", 98)]
    df = spark.createDataFrame(rows, "day string, v string, k int")
    series = trend.moving_average(df, "day", "v", "k")
    assert series.count() == 11 and trend.trend_summary(series).count() == 0


def test_flat_series_is_flat(spark):
    df = spark.range(20).select(F.expr("timestamp'2024-01-01' + make_interval(0,0,0,id)").alias("ts"), F.lit(5.0).alias("v"), "id")
    s = trend.trend_summary(trend.moving_average(df, "ts", "v", "id")).first()
    assert s["direction"] == "flat" and s["slope"] == 0.0 and s["p_value"] == 1.0


def test_segments_need_three_rows_each(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("b", 6.0), (None, 9.0), ("c", None)], "s string, v double")
    assert [r["segment"] for r in segments.segment_statistics(df, "s", "v").collect()] == ["a"]
    assert segments.anova(df, "s", "v").count() == 0 and segments.segment_ranking(df, "s", "v").count() == 0


def test_anova_matches_the_sums_of_squares(spark):
    rng = np.random.default_rng(6)
    groups = {g: rng.normal(m, 1, 20 + i) for i, (g, m) in enumerate([("a", 0.0), ("b", 0.3), ("c", 1.0)])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    r = segments.anova(spark.createDataFrame(rows, "s string, v double"), "s", "v").first()
    every = np.concatenate(list(groups.values()))
    between = sum(len(v) * (v.mean() - every.mean()) ** 2 for v in groups.values()) / 2
    within = sum(((v - v.mean()) ** 2).sum() for v in groups.values()) / (len(every) - 3)
    f, d2 = between / within, len(every) - 3
    assert r["f_statistic"] == pytest.approx(f, abs=1e-4) and r["p_value"] == pytest.approx((1 + 2 * f / d2) ** (-d2 / 2), abs=1e-5)


@pytest.mark.parametrize("n", [20, 400])
def test_forest_scores_rank_planted_outliers_first(spark, n):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 2))
    x[3] = [12, -12]
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(n), "a": x[:, 0], "b": x[:, 1]}))
    scores = outliers.outlier_scores(df, ["k"]).persist()
    assert scores.where("score <= -1 or score >= 0").count() == 0 and scores.count() == n
    assert outliers.most_anomalous(scores, ["k"]).first()["k"] == 3
    share = outliers.outlier_share(outliers.flag_outliers(scores)).first()["outlier_pct"]
    assert 0 < share <= 0.05 + 1 / n


def test_forest_scores_do_not_depend_on_partitions(spark):
    df = spark.range(300).select("id", F.sin("id").alias("a"), F.cos(F.col("id") * 2).alias("b"))
    one = {r["id"]: r["score"] for r in outliers.outlier_scores(df.coalesce(1), ["id"], ["a", "b"]).collect()}
    many = {r["id"]: r["score"] for r in outliers.outlier_scores(df.repartition(7), ["id"], ["a", "b"]).collect()}
    assert one == many


def test_every_tree_gets_its_own_rows_when_the_table_is_large(spark):
    s = Settings(forest_trees=5)
    df = spark.range(4000).select("id", F.col("id").cast("double").alias("a"))
    rows = outliers.complete_rows(df, ["id"], ["a"])
    sample = outliers.tree_samples(rows, ["id"], 4000, s).toPandas()
    assert sample.groupby("tree").size().tolist() == [256] * 5 and sample["_key"].is_unique


def test_copies_of_one_row_do_not_break_the_forest(spark):
    df = spark.range(600).select("id", F.when(F.col("id") < 200, 1.0).otherwise(F.col("id").cast("double")).alias("a"))
    assert outliers.outlier_scores(df, ["id"], ["a"]).where("score is null").count() == 0


def test_too_few_complete_rows_give_no_scores(spark):
    df = spark.range(25).select("id", F.when(F.col("id") < 19, 1.0).alias("a"))
    assert outliers.outlier_scores(df, ["id"], ["a"]).count() == 0


def test_bootstrap_is_stable_for_a_strong_pair_and_repeatable(spark):
    df = spark.range(500).select("id", F.col("id").cast("double").alias("x"), (F.col("id") + 20 * F.randn(1)).alias("y")).persist()
    s = confidence.bootstrap_stability(df, ["id"], "x", "y").first()
    assert s["usable"] == 50 and s["stability"] > 0.95
    again = confidence.bootstrap_stability(df.repartition(9), ["id"], "x", "y").first()
    assert again["stability"] == pytest.approx(s["stability"], abs=1e-9)
    reps = confidence.bootstrap_correlations(df, ["id"], "x", "y").toPandas()
    assert len(reps) == 50 and reps["r"].nunique() == 50


def test_bootstrap_defaults(spark):
    few = spark.range(19).select("id", F.col("id").alias("x"), F.col("id").alias("y"))
    assert confidence.bootstrap_stability(few, ["id"], "x", "y").first()["stability"] == 0.4
    flat = spark.range(50).select("id", F.col("id").alias("x"), F.lit(1).alias("y"))
    assert confidence.bootstrap_stability(flat, ["id"], "x", "y").first()["stability"] == 0.5


def test_confidence_parts(spark):
    row = spark.range(1).select(
        confidence.quality_score(F.lit(99), F.lit(0.5), F.lit(1)).alias("q"), confidence.significance_score(F.lit(0.01)).alias("s"),
        confidence.significance_score(F.lit(None).cast("double")).alias("none"),
        confidence.composite(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("c"),
        confidence.composite(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0)).alias("unknown"),
    ).first()
    assert row["q"] == pytest.approx(0.3) and row["s"] == 0.7 and row["none"] == 0.6 and row["c"] == 1.0 and row["unknown"] is None


def test_box_whiskers_stay_within_the_fences(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]], "v double")
    b = charts.box_table(df, ["v"]).first()
    assert (b["max"], b["upper_whisker"], b["lower_whisker"], b["median"]) == (100.0, 5.0, 1.0, 3.5)


def test_constants_are_seen_as_constants_over_many_partitions(spark):
    """Merged variances of 0.1 are not exactly zero; the operators must not care."""
    from assay.operators.features import fit_preparation
    from assay.operators.profile import column_profile

    df = spark.range(301).select(
        "id", F.lit(0.1).alias("flat"), F.when(F.col("id") % 2 == 0, 0.1).alias("holes"), F.rand(2).alias("x"),
        F.expr("timestamp'2024-01-01' + make_interval(0,0,0,id)").alias("ts"), F.lit("s").alias("s"),
    ).repartition(7).persist()
    assert not any("flat" in k or "holes" in k for k in pairs(df))
    p = {r["name"]: r for r in column_profile(df).collect()}
    assert p["flat"]["std"] == 0.0 and p["holes"]["skew"] == 0.0
    m = {r["column"]: r for r in distribution.moments(df, ["flat", "holes"]).collect()}
    assert m["flat"]["kurtosis"] == 0.0 and m["holes"]["skew"] == 0.0
    s = trend.trend_summary(trend.moving_average(df, "ts", "flat", "id")).first()
    assert s["direction"] == "flat" and s["p_value"] == 1.0
    assert fit_preparation(df, ["flat"], []).numeric["flat"][2] == 0.0
    assert confidence.bootstrap_correlations(df, ["id"], "x", "flat").count() == 0


def test_infinite_values_give_no_findings(spark):
    from assay.operators.correlation import correlation_analysis, top_correlations
    from assay.operators.distribution import distribution_analysis

    rows = [(float(i), float((i * 37) % 11), float(i % 7)) for i in range(40)] + [(float("inf"), 3.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    assert {(r["a"], r["b"]) for r in correlation_analysis(df).collect()} == {("b", "c")}
    assert {(r["a"], r["b"]) for r in top_correlations(df).collect()} == {("b", "c")}
    shape = {r["column"]: r for r in distribution_analysis(df).collect()}["a"].asDict()
    assert "strongly" not in str(shape.values())
