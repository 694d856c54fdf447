import glob
import tempfile
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from assay.functions import lineage
from assay.functions.columns import clean_input
from assay.operators import clustering, explain, features, forest, linear, supervised
from assay.settings import Settings

# Few trees keep the tests short; the operators are the same.
QUICK = Settings(forest_trees=10)


def test_kinds(churn):
    rows = {r["name"]: r for r in features.feature_kinds(churn).collect()}
    assert rows["customer_id"]["id_like"] and rows["customer_id"]["kind"] == "dropped"
    assert rows["contract_type"]["kind"] == "categorical" and rows["tenure_months"]["kind"] == "numeric"
    assert not rows["monthly_charges"]["id_like"]


@pytest.mark.parametrize("n,id_like", [(19, False), (20, True)])
def test_id_needs_twenty_rows(spark, n, id_like):
    assert features.feature_kinds(spark.range(n)).first()["id_like"] is id_like


def test_text_id_is_known_by_its_name(spark):
    df = spark.range(40).select(F.concat(F.lit("u"), "id").alias("user_id"), F.concat(F.lit("u"), "id").alias("note"))
    rows = {r["name"]: r for r in features.feature_kinds(df).collect()}
    assert rows["user_id"]["id_like"] and not rows["note"]["id_like"] and rows["note"]["kind"] == "dropped"


def test_preparation_fills_scales_and_encodes(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (3.0, "a"), (8.0, None), (4.0, "b")], "x double, c string")
    prep = features.fit_preparation(df, ["x"], ["c"])
    got = df.select(*prep.columns()).toPandas()
    x = np.array([1, 3.5, 3, 8, 4])
    assert np.allclose(got["x"], (x - x.mean()) / x.std())
    assert got["c=a"].tolist() == [0, 1, 1, 1, 0]
    unseen = spark.createDataFrame([(1.0, "z")], "x double, c string").select(*prep.columns()).first()
    assert unseen["c=a"] == 0 and unseen["c=b"] == 0


@pytest.mark.parametrize("strata", [None, "s"])
def test_folds_are_disjoint_balanced_and_repeatable(spark, strata):
    df = spark.range(103).select("id", F.when(F.col("id") < 70, "hot").otherwise("cold").alias("s"))
    a = features.assign_folds(df.repartition(5), ["id"], 5, strata).toPandas()
    b = features.assign_folds(df.coalesce(1), ["id"], 5, strata).toPandas()
    assert a.sort_values("id")["fold"].tolist() == b.sort_values("id")["fold"].tolist() and len(a) == 103
    sizes = a.groupby(["s", "fold"] if strata else ["fold"]).size()
    groups = sizes.groupby(level=0) if strata else [(None, sizes)]
    assert all(g.max() - g.min() <= 1 for _, g in groups)


def test_fold_counts():
    assert [features.fold_count(n) for n in (30, 45, 50, 10**9)] == [3, 4, 5, 5]
    assert [features.stratified_fold_count(n) for n in (1, 3, 9)] == [2, 3, 5]


def test_row_budget_draws_a_repeatable_sample(spark):
    df = spark.range(2000).select("id", F.col("id").alias("y"))
    s = Settings(max_modeling_rows=500)
    a = features.prepare_rows(df, "y", [], ["id"], s).toPandas()["id"]
    b = features.prepare_rows(df.repartition(3), "y", [], ["id"], s).toPandas()["id"]
    assert set(a) == set(b) and 400 < len(a) < 600
    assert features.prepare_rows(df, "y", [], ["id"]).count() == 2000


def test_rare_classes_are_dropped(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 4, "c string")
    assert [tuple(r) for r in features.keep_frequent_classes(df, "c").distinct().collect()] == [("a",)]


def test_linear_models_of_all_folds_match_their_closed_forms(spark):
    """Nulls, a constant, a category seen in one fold only, dependent columns, a large offset."""
    rng = np.random.default_rng(9)
    n, k = 123, 3
    pdf = pd.DataFrame({"fold": np.arange(n) % k, "a": 1e6 + rng.normal(size=n), "b": rng.normal(size=n), "flat": 7.0, "c": rng.choice(["u", "v", "w"], n)})
    pdf["d"] = pdf["b"] * 2
    pdf.loc[pdf["fold"] == 1, "c"] = pdf.loc[pdf["fold"] == 1, "c"].replace("w", "only")
    pdf["_label"] = 5e3 + 3 * (pdf["a"] - 1e6) + pdf["b"] + (pdf["c"] == "u") + rng.normal(size=n)
    pdf.loc[::7, "a"] = np.nan
    pdf["c"] = [None if i % 10 == 0 else c for i, c in enumerate(pdf["c"])]
    df = clean_input(spark.createDataFrame(pdf, "fold int, a double, b double, flat double, c string, d double, _label double"))
    m = linear.fold_moments(df.repartition(4), k, ["a", "b", "flat", "d"], ["c"])
    for fold in range(-1, k):
        train = pdf[pdf["fold"] != fold]
        filled = pdf.assign(a=pdf["a"].fillna(train["a"].median()), c=pdf["c"].fillna(train["c"].mode()[0]))
        tr = filled[filled["fold"] != fold]
        parts = [(filled[x] - tr[x].mean()) / (tr[x].std(ddof=0) or 1) for x in ("a", "b", "flat", "d")] + [(filled["c"] == v) * 1.0 for v in sorted(train["c"].dropna().unique())]
        x = np.column_stack(parts)
        prep = m.preparation(fold)
        assert prep.categorical["c"] == (train["c"].mode()[0], sorted(train["c"].dropna().unique()))
        for name in ("a", "b", "flat", "d"):
            assert np.allclose(prep.numeric[name], (train[name].median(), tr[name].mean(), tr[name].std(ddof=0)), rtol=1e-9, atol=1e-9)
        inside = (pdf["fold"] != fold).to_numpy()
        y = pdf["_label"].to_numpy()
        xc, yc = x[inside] - x[inside].mean(0), y[inside] - y[inside].mean()
        for penalty in (0.0, 1.0):
            b = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ yc) if penalty else np.linalg.lstsq(xc, yc, rcond=1e-8)[0]
            want = y[inside].mean() + (x - x[inside].mean(0)) @ b
            assert np.allclose(m.fit(fold, penalty).predict(x), want, atol=1e-6)
            if fold >= 0:
                out, held = ~inside, y[~inside]
                r2 = 1 - ((held - want[out]) ** 2).sum() / ((held - held.mean()) ** 2).sum()
                assert m.score(fold, penalty) == pytest.approx(r2, abs=1e-8)


def test_medians_of_all_folds_come_from_one_count(spark, monkeypatch):
    """A value is counted once for all folds; narrowing down many values gives the same."""
    rng = np.random.default_rng(33)
    pdf = pd.DataFrame({"fold": np.arange(331) % 3, "a": rng.integers(0, 30, 331) / 4, "b": rng.normal(size=331), "none": np.nan, "late": np.where(np.arange(331) % 3 == 1, 5.0, np.nan)})
    df = clean_input(spark.createDataFrame(pdf, "fold int, a double, b double, none double, late double"))
    narrowed = linear.fold_medians(df, ["a", "b", "none", "late"], 3, Settings(direct_quantile_values=20))
    monkeypatch.setattr(linear, "exact_quantiles", None)
    counted = linear.fold_medians(df, ["a", "b", "none", "late"], 3)
    for fold in range(-1, 3):
        want = pdf[pdf["fold"] != fold][["a", "b", "late"]].median().dropna().to_dict()
        assert counted[fold] == pytest.approx(want) and narrowed[fold] == pytest.approx(want)


def test_one_scan_serves_all_folds(spark):
    df = spark.range(100).select((F.col("id") % 5).cast("int").alias("fold"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("_label"))
    df.write.mode("overwrite").parquet(path := tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/t")
    products = linear.cross_products(spark.read.parquet(path), linear.stored_columns(["x"], {}, {"x": 0.0}, F.col("_label")), 5)
    plan = products._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def naive_tree(x, y, w):
    """Every split of every feature, by trying them all."""
    def grow(rows):
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for a, b in zip(values[:-1], values[1:]):
                left, right = rows[x[rows, f] <= a], rows[x[rows, f] > a]
                gain = (w[left] @ y[left]) ** 2 / w[left].sum() + (w[right] @ y[right]) ** 2 / w[right].sum()
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, a + (b - a) / 2, left, right)
        if best is None or len(set(y[rows])) == 1:
            return (w[rows] @ y[rows]) / w[rows].sum()
        return best[1], best[2], grow(best[3]), grow(best[4])

    return grow(np.flatnonzero(w > 0))


def test_trees_equal_exhaustive_search():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, (60, 1)).astype(float)  # one feature: equal gains of different features are not ordered here
    y = rng.normal(size=60)
    y[:9] = 1.0
    weights = [rng.poisson(1, 60) * rng.uniform(0.5, 2, 60) for _ in range(5)]
    nodes = forest.grow(x, y, y[:, None], weights, forest.tree_seeds(np.arange(5), 1), 1)
    for t, w in enumerate(weights):
        tree = naive_tree(x, y, w)

        def walk(node, row):
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        got = nodes.value[nodes.leaf_of(x, np.full(60, t)), 0]
        assert np.allclose(got, [walk(tree, r) for r in x])
    wide = rng.normal(size=(60, 4))
    several = forest.grow(wide, y, y[:, None], weights, forest.tree_seeds(np.arange(5), 1), 4)
    for t, w in enumerate(weights):
        tree, inside = naive_tree(wide, y, w), w > 0
        assert (several.feature[t], several.threshold[t]) == (tree[0], pytest.approx(tree[1]))
        assert np.allclose(several.value[several.leaf_of(wide, np.full(60, t)), 0][inside], y[inside])  # pure leaves
    packed = forest.Nodes.unpack(nodes.pack())
    assert np.array_equal(packed.leaf_of(x, np.zeros(60)), nodes.leaf_of(x, np.zeros(60)))


def test_categories_are_counted_not_sorted(monkeypatch):
    """Every split is the best of the drawn features, or the next that splits; only the column of many values is ordered."""
    rng = np.random.default_rng(31)
    n, trees, per_split = 400, 3, 2
    codes = [rng.integers(0, k, n) for k in (5, 7)]
    x = np.column_stack([rng.normal(size=n), (rng.random(n) < 0.2) * 3.0 - 1, np.full(n, 4.0)] + [(c == v) * 1.0 for c in codes for v in range(c.max() + 1)])
    y = ((codes[0] == 2) ^ (rng.random(n) < 0.3)).astype(float)
    values, weights = np.eye(2)[y.astype(int)], [rng.poisson(1, n) * rng.uniform(0.5, 2, n) for _ in range(trees)]
    sorted_ = []
    real = np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *r, **k: (sorted_.append(np.size(a)), real(a, *r, **k))[1])
    nodes = forest.grow(x, y, values, weights, forest.tree_seeds(np.arange(trees), 1), per_split)
    monkeypatch.undo()
    assert sorted_ == [n]

    def gain(w, rows, left):
        return sum(((w[m] @ values[m]) ** 2).sum() / w[m].sum() for m in (rows[left], rows[~left]))

    looked = 0
    for t, w in enumerate(weights):
        open_ = [(t, np.flatnonzero(w > 0), forest.tree_seeds(np.array([t]), 1))]
        while open_:
            at, rows, seed = open_.pop()
            assert np.allclose(nodes.value[at], (w[rows] @ values[rows]) / w[rows].sum())
            best = {}
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    best[f] = max(best.get(f, -1.0), gain(w, rows, x[rows, f] <= cut))
            if len(set(y[rows])) == 1 or not best:
                assert nodes.feature[at] == -1
                continue
            ranks, f = forest.feature_ranks(seed, x.shape[1])[0], nodes.feature[at]
            drawn = [g for g in best if ranks[g] < per_split]
            left = x[rows, f] <= nodes.threshold[at]
            assert f in drawn if drawn else f == min(best, key=lambda g: ranks[g])
            assert gain(w, rows, left) == pytest.approx(max(best[g] for g in drawn or [f]))
            looked += 1
            for side, mine in ((0, left), (1, ~left)):
                open_.append((nodes.left[at] + side, rows[mine], forest.child_seeds(seed, side)))
    assert looked > 100


def prepared(spark, x, y, weight=None):
    rows = [(i * 7919 + 13, float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "_row long, _label double, x array<double>")
    return df.select("_row", "_label", array_to_vector("x").alias("_features"))


def test_forest_reaches_a_target_fifteen_splits_deep(spark):
    """The parity of the leading 15 bits needs every one of them on its path."""
    x = np.arange(1 << 15)[:, None].astype(float)
    y = np.array([bin(v).count("1") % 2 for v in range(1 << 15)], float)
    model = forest.fit_forest(prepared(spark, x, y), 8, 1)
    got = model.transform(prepared(spark, x, y)).select("_label", "prediction").toPandas()
    assert ((got["prediction"] > 0.5) == (got["_label"] > 0.5)).mean() > 0.9
    nodes = forest.Nodes.unpack(bytes(model.parts.first()["blob"]))
    depth, at = 0, np.array([0])
    while len(at):
        at = at[nodes.feature[at] >= 0]
        at = np.r_[nodes.left[at], nodes.left[at] + 1]
        depth += 1
    assert depth > 15


@pytest.mark.parametrize("classes", [0, 3])
def test_large_nodes_are_split_across_tasks(spark, monkeypatch, classes):
    """With room for 60 rows a task, the same data goes through histograms, parts and the join of rows and parts."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=900), rng.integers(0, 5, 900), rng.normal(size=900)])
    y = (x[:, 0] > 0) + (x[:, 1] > 2) if classes else 3 * x[:, 0] + x[:, 1]
    train = prepared(spark, x, y)
    small = forest.fit_forest(train, 6, 1, classes)
    wide = forest.fit_forest(train, 6, 1, classes, task_cells=180)
    assert not wide.top.open and len(wide.top.parts) > (0 if classes else 30) and (wide.top.nodes.feature >= 0).sum() > 10 and small.top.nodes.feature.max() == -1
    assert wide.parts.count() == len(wide.top.parts)
    one = small.transform(train).orderBy("_row").toPandas()["prediction"]
    two = wide.transform(train).orderBy("_row").toPandas()["prediction"]
    monkeypatch.setattr(forest, "BROADCAST_BYTES", 0)
    three = wide.transform(train).orderBy("_row").toPandas()["prediction"]
    assert np.allclose(two, three)
    if classes:
        assert (one == y).mean() > 0.95 and (two == y).mean() > 0.95
    else:
        assert np.corrcoef(one, y)[0, 1] > 0.98 and np.corrcoef(two, y)[0, 1] > 0.98 and np.abs(one - two).mean() < 0.3


def test_scores_match_their_definitions(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0), (2.0, 0.0)], "_label double, prediction double")
    # class 0: f1 = 4/6, class 1: f1 = 2/3, class 2: 0; weights 2, 2, 1
    assert supervised.weighted_f1(df, []).first()["score"] == pytest.approx((2 * 4 / 6 + 2 * 2 / 3) / 5)
    y, p = np.array([1, 1, 0, 0, 2.0]), np.array([1, 0, 0, 0, 0.0])
    assert supervised.r2_score(df, []).first()["score"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(10)
    n = 300
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "noise": rng.normal(size=n), "c": rng.choice(["u", "v"], n)})
    pdf["y"] = 3 * pdf["a"] + (pdf["c"] == "u") * 2 + rng.normal(size=n) * 0.1
    pdf.loc[::11, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    return supervised.train_regression(df, "y", ["id", "a", "noise", "c"], ["id"], QUICK)


def test_regression_finds_the_driver(regression):
    assert regression.trained and regression.n_samples == 300 and regression.cv_mean <= 1
    rows = [(r["feature"], r["importance"]) for r in regression.feature_importance.collect()]
    assert rows[0][0] == "a" and dict(rows)["id"] == 0.0 and abs(dict(rows)["noise"]) < 0.05
    assert sorted({r["model"] for r in regression.cv_scores.collect()}) == ["LinearRegression", "RandomForest", "Ridge"]


def test_explanation_of_a_regression(regression):
    e = explain.explain_model(regression)
    ranked = {r["feature"]: r["direction"] for r in e["global_importance"].collect()}
    assert ranked["a"] == "increases" and ranked["c"] == "varies by category"
    assert e["sentences"].first()["sentence"].startswith("A is the leading feature — higher A goes with a higher")
    rows = e["rows"].where("id = 0 and feature = 'a'").first()
    assert rows["vs_average"] == "below" and rows["value"] is None and float(rows["prediction"])


def test_explained_rows_are_not_scored_for_their_means(spark, regression, monkeypatch):
    ranked = spark.createDataFrame([(1, "a", 1.0, "increases")], "rank int, feature string, importance double, direction string")
    fail = F.udf(lambda x: 1 / 0, "double")
    monkeypatch.setattr(type(regression), "predict", lambda self, df: df.withColumn("prediction", fail(F.lit(1.0))).withColumn("a", F.col("a") + F.col("prediction") * 0))
    out = explain.explain_rows(regression, ranked)  # nothing is scored before the result is read
    assert out.columns[:2] == ["id", "rank"]


def test_permuting_keeps_a_features_columns_together(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(2500), "a": rng.normal(size=2500), "c": rng.choice(["u", "v", "w"], 2500)})
    pdf["_label"] = pdf["a"] * 2 + (pdf["c"] == "u")
    prep = features.Preparation({"a": (0.0, 0.0, 1.0)}, {"c": ("u", ["u", "v", "w"])})
    model = linear.LinearModel(0.0, np.array([2.0, 1.0, 0.0, 0.0]))

    class Brought:
        def scorer(self):
            def score(x):
                assert np.array_equal(x[:, 1:].sum(1), np.ones(len(x)))
                return model.predict(x)

            return score

    class TooLarge:  # rows go to the model instead
        scorer = staticmethod(lambda: None)
        transform = staticmethod(model.transform)

    df = spark.createDataFrame(pdf)
    got = supervised.permuted_scores(df.repartition(3), ["id"], prep, Brought(), "r2", 4, 1).toPandas().set_index(["feature", "repeat"])["score"]
    again = supervised.permuted_scores(df.coalesce(1), ["id"], prep, TooLarge(), "r2", 4, 1).toPandas().set_index(["feature", "repeat"])["score"]
    assert len(got) == 9 and got.loc[("", 0)] == pytest.approx(1.0) and np.allclose(got.sort_index(), again.sort_index())
    spread = pdf["_label"].var(ddof=0)
    # Permuted columns lose twice their variance.
    assert got.loc["a"].mean() == pytest.approx(1 - 2 * 4 * pdf["a"].var(ddof=0) / spread, abs=0.05)
    assert got.loc["c"].mean() == pytest.approx(1 - 2 * (pdf["c"] == "u").var(ddof=0) / spread, abs=0.05)


def test_too_little_data_is_not_trained(spark, churn):
    few = spark.range(29).select("id", F.col("id").cast("double").alias("x"), F.rand(1).alias("y"))
    assert not supervised.train_regression(few, "y", ["x"], ["id"], QUICK).trained
    one = churn.withColumn("churn", F.lit(1))
    assert not supervised.train_classification(one, "churn", ["tenure_months"], ["customer_id"], QUICK).trained
    rare = churn.withColumn("churn", F.when(F.col("customer_id") < 10004, 1).otherwise(0))
    r = supervised.train_classification(rare, "churn", ["tenure_months"], ["customer_id"], QUICK)
    assert not r.trained and "rare classes" in r.message
    assert explain.explain_model(r) == {"available": False, "reason": r.message}


def test_classification_trains_and_names_its_classes(churn):
    cols = ["customer_id", "tenure_months", "monthly_charges", "contract_type", "support_calls"]
    r = supervised.train_classification(churn, "churn", cols, ["customer_id"], QUICK)
    assert r.trained and r.classes == ["0", "1"] and 0 < r.cv_mean <= 1
    assert {x["prediction"] for x in r.predict(r.rows).select("prediction").distinct().collect()} <= {"0", "1"}
    top = [x["feature"] for x in r.feature_importance.collect()][:3]
    assert "tenure_months" in top and "customer_id" not in top


def test_silhouette_agrees_with_the_library(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"x": rng.normal(size=150), "y": rng.normal(size=150), "prediction": rng.integers(0, 3, 150)})
    df = spark.createDataFrame(pdf)
    want = ClusteringEvaluator(featuresCol="f").evaluate(VectorAssembler(inputCols=["x", "y"], outputCol="f").transform(df))
    assert clustering.silhouette(df, "prediction", ["x", "y"], metric="squared").first()["silhouette"] == pytest.approx(want, abs=1e-4)


def test_clustering_finds_planted_groups(spark, monkeypatch):
    monkeypatch.setattr(clustering, "RESTARTS", 2)
    monkeypatch.setattr(clustering, "MAX_K", 4)
    rng = np.random.default_rng(13)
    centre = np.repeat([[0, 0], [10, 0], [0, 10]], 40, axis=0)
    x = centre + rng.normal(size=(120, 2)) * 0.3
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(120), "x": x[:, 0], "y": x[:, 1]}))
    r = clustering.train_clustering(df, ["k", "x", "y"], ["k"])
    assert r.best_k == 3 and r.silhouette > 0.9 and sorted(s["n"] for s in r.cluster_size.collect()) == [40, 40, 40]
    said = explain.explain_model(r)["sentences"].collect()
    assert len(said) == 3 and "(40 rows)" in said[0]["sentence"]


def test_clustering_needs_numbers_and_rows(spark):
    few = spark.range(19).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"))
    assert not clustering.train_clustering(few, ["a", "b"], ["id"]).trained
    assert not clustering.train_clustering(spark.range(50).select("id", F.rand(1).alias("a")), ["a"], ["id"]).trained


def test_cluster_description_by_size_or_by_spread(spark):
    p = spark.createDataFrame([(0, 100.0, 1.0), (1, 101.0, -9.0)], "cluster int, a double, b double")
    n = spark.createDataFrame([(0, 5), (1, 6)], "cluster int, n int")
    assert {r["feature"] for r in explain.describe_clusters(p, n, ["a", "b"]).collect()} == {"a"}
    assert explain.describe_clusters(p, n, ["a", "b"], spread=True).count() == 2


def plain_silhouette(x, c):
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        means = {k: gaps[i][c == k].sum() / ((c == k).sum() - (k == c[i])) if (c == k).sum() > (k == c[i]) else None for k in set(c)}
        a, b = means[c[i]], min(v for k, v in means.items() if k != c[i])
        out.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    return np.mean(out)


def test_silhouette_equals_its_definition_over_blocks(spark, monkeypatch):
    """Clusters apart (bounds leave most out), overlapping ones, one of a single row, equal points; rows over many blocks."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (600, 2)), rng.normal(8, 1, (500, 2)), rng.normal(9, 2, (398, 2)), [[50.0, 50.0]], [[0.0, 0.0]]])
    c = np.array(["a"] * 600 + ["b"] * 500 + ["c"] * 398 + ["lone", "a"])
    df = spark.createDataFrame([(k, float(p), float(q)) for k, (p, q) in zip(c, x)] + [(None, 1.0, 1.0), ("a", None, 1.0)], "c string, p double, q double")
    want = plain_silhouette(x, c)
    for rows in (2048, 97):
        monkeypatch.setattr(clustering, "BLOCK_ROWS", rows)
        got = clustering.silhouette(df.repartition(5), "c", ["p", "q"]).first()
        assert (got["n"], got["clusters"]) == (1500, 4) and got["silhouette"] == pytest.approx(want, abs=6e-5)
    part = clustering.silhouette(df, "c", ["p", "q"], sampled=300).first()["silhouette"]
    assert part != pytest.approx(want, abs=1e-9) and part == pytest.approx(want, abs=0.08)
    assert clustering.silhouette(df.limit(0), "c", ["p", "q"]).first()["n"] == 0
    assert clustering.silhouette(df.where("c = 'b'"), "c", ["p", "q"]).first()["silhouette"] is None


def test_all_models_step_in_one_scan(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 0.3, (150, 3)) for m in (0, 3, 6)])
    vectors = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(3)
    starts = {(k, s): clustering.starting_centers(x, k, s) for k in (2, 3, 5) for s in range(4)}
    got = clustering.fit_all(vectors, starts, float(x.var(axis=0).mean()))
    for name, centers in starts.items():
        while True:  # Lloyd's steps of one model
            to = ((x[:, None] - centers) ** 2).sum(2).argmin(1)
            new = np.array([x[to == i].mean(0) if (to == i).any() else centers[i] for i in range(len(centers))])
            cost = ((x - centers[to]) ** 2).sum()
            if ((new - centers) ** 2).sum() <= clustering.TOLERANCE * x.var(axis=0).mean():
                break
            centers = new
        assert np.allclose(got[name][0], centers) and got[name][1] == pytest.approx(cost)
    steps, counted = [], clustering.lloyd_step
    try:
        clustering.lloyd_step = lambda v, m: steps.append(len(m)) or counted(v, m)
        clustering.fit_all(vectors, starts, 1.0)
    finally:
        clustering.lloyd_step = counted
    assert steps[0] == len(starts) and steps == sorted(steps, reverse=True)


def test_a_step_is_one_job(spark):
    vectors = spark.createDataFrame([([float(i), 1.0],) for i in range(60)], "x array<double>").repartition(3).persist()
    vectors.count()
    spark.sparkContext.setJobGroup("one step", "")
    clustering.lloyd_step(vectors, [np.array([[1.0, 1.0], [50.0, 1.0]])])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one step")) == 1


def test_equal_rows_are_one_point_with_their_number(spark):
    """The number may be given or counted; a point that is alone in its cluster twice is not alone."""
    rng = np.random.default_rng(21)
    x, c, m = rng.normal(size=(90, 2)).round(1), rng.integers(0, 3, 90), rng.integers(1, 30, 90)
    x, c, m = np.r_[x, [[9.0, 9.0]]], np.r_[c, 3], np.r_[m, 2]
    want = plain_silhouette(np.repeat(x, m, axis=0), np.repeat(c, m))
    points = spark.createDataFrame([(int(k), v.tolist(), int(n)) for k, v, n in zip(c, x, m)], "c int, x array<double>, m long")
    each = points.select("c", "x", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    for rows in (points, each.select("c", "x")):
        got = clustering.euclidean_silhouette(rows).first()
        assert (got["n"], got["clusters"]) == (int(m.sum()), 4) and got["silhouette"] == pytest.approx(want, abs=6e-5)
    assert [clustering.block_rows(p) for p in (100, 900_000, 10**9)] == [2048, 14063, 65536]


def test_a_step_counts_every_row_of_a_point(spark):
    rng = np.random.default_rng(22)
    x, m = rng.normal(size=(80, 2)).round(1), rng.integers(1, 40, 80)
    models = [x[:3], x[5:9]]
    points = spark.createDataFrame([(v.tolist(), int(n)) for v, n in zip(x, m)], "x array<double>, m long")
    rows = points.select("x", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))).select("x")
    for a, b in zip(clustering.lloyd_step(points, models), clustering.lloyd_step(rows, models)):
        assert np.allclose(a, b) and a[:, 0].sum() == m.sum()


def test_a_point_draws_as_often_as_its_rows():
    rows, seed = np.arange(60_000, dtype=np.int64) * 7919, forest.tree_seeds(np.arange(1), 1)[0]
    copies = np.resize([1, 4, 60, 2500], 60_000)
    got = forest.bootstrap_weights(rows, seed, copies)
    for m in (1, 4, 60, 2500):
        mine = got[copies == m]
        assert mine.mean() == pytest.approx(m, rel=0.03) and mine.var() == pytest.approx(m, rel=0.06)
    assert (got[copies == 1] == forest.bootstrap_weights(rows, seed)[copies == 1]).all()


def test_equal_rows_grow_one_leaf_and_jobs_their_own_tasks(spark):
    rng = np.random.default_rng(23)
    x = rng.normal(size=(50, 2))
    train = prepared(spark, np.repeat(x, 40, axis=0), np.repeat(x[:, 0], 40))
    model = forest.fit_forest(train, 12, 1)
    assert sum(len(forest.Nodes.unpack(bytes(r["blob"])).feature) for r in model.parts.collect()) <= 12 * 99
    assert np.allclose(*model.transform(train).select("_label", "prediction").toPandas().to_numpy().T, atol=1e-9)
    assert model.parts.select("group").distinct().count() == 12 and len({r[0] for r in model.parts.select(F.input_file_name()).collect()}) > 1


def test_a_forest_meets_the_blocks_in_bundles(spark, monkeypatch):
    rng = np.random.default_rng(24)
    pdf = pd.DataFrame({"id": np.arange(2500), "a": rng.normal(size=2500), "b": rng.normal(size=2500)})
    pdf["_label"] = pdf["a"] * 2 + pdf["b"]
    prep, df = features.Preparation({"a": (0.0, 0.0, 1.0), "b": (0.0, 0.0, 1.0)}, {}), spark.createDataFrame(pdf)
    train = df.select(F.xxhash64("id").alias("_row"), "_label", prep.vector().alias("_features"))
    for classes in (0, 2):
        rows = df if not classes else df.withColumn("_label", (F.col("_label") > 0).cast("double"))
        model = forest.fit_forest(train if not classes else train.withColumn("_label", (F.col("_label") > 0).cast("double")), 3, 1, classes)
        metric = "f1" if classes else "r2"
        monkeypatch.setattr(forest, "BROADCAST_BYTES", 128 << 20)
        one = supervised.permuted_scores(rows, ["id"], prep, model, metric, 2, 1).toPandas().set_index(["feature", "repeat"])["score"]
        monkeypatch.setattr(forest, "BROADCAST_BYTES", 0)
        assert model.bundles() == 3
        several = supervised.permuted_scores(rows, ["id"], prep, model, metric, 2, 1).toPandas().set_index(["feature", "repeat"])["score"]
        assert len(one) == 5 and np.allclose(one.sort_index(), several.sort_index())
        assert one.loc[("", 0)] > 0.95 and one.loc["a"].mean() < one.loc["b"].mean() < one.loc[("", 0)]


def test_few_rows_go_to_the_trees(spark):
    """Each task that scores gets a share of the trees instead of all of them; predictions stay."""
    rng = np.random.default_rng(32)
    x = rng.normal(size=(600, 2))
    train = prepared(spark, x, x[:, 0] * x[:, 1] + rng.normal(size=600))
    model = forest.fit_forest(train, 24, 1)
    trees, met = sum(size for _, size in model.sizes), []
    assert trees == model.parts.agg(F.sum(F.octet_length("blob"))).first()[0] and model.bundles() == 1
    model.meet, meet = lambda *a: (met.append(a[-1]), meet(*a))[1], model.meet
    few, most = model.transform(train.limit(5)), model.bundle_bytes(5 * 56.0, 8)
    assert model.bundles(met[0]) > 1 and most < trees / 4 and model.bundle_bytes(1e12, 8) == trees
    model.bundle_bytes = lambda *a: trees
    few, alone = few.toPandas(), model.transform(train).toPandas()
    assert np.allclose(few.set_index("_row")["prediction"], alone.set_index("_row")["prediction"].loc[few["_row"]])


def test_forests_of_folds_leave_no_files(spark):
    """Working tables of a fold go with its score; packed trees take about nine bytes a node."""
    held = lambda: {p for name in ("forest", "scored") for p in glob.glob(f"{lineage._checkpoint_folder(spark).removeprefix('file:')}/{name}-*")}
    before = held()
    df = spark.range(120).select("id", (F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 7 * 3 + F.col("id") % 50).cast("double").alias("y"))
    result = supervised.train_regression(df, "y", ["a"], ["id"], Settings(forest_trees=3), importance=False)
    assert "RandomForest" in {r["model"] for r in result.cv_scores.collect()}
    assert len(held() - before) == (result.best_model == "RandomForest")
    x = np.random.default_rng(35).normal(size=(300, 2))
    nodes = forest.grow(x, x[:, 0], x[:, :1], [np.ones(300)] * 2, forest.tree_seeds(np.arange(2), 1), 2)
    again = forest.Nodes.unpack(nodes.pack())
    assert len(nodes.pack()) < 9 * len(nodes.feature) + 40 and np.array_equal(again.feature, nodes.feature)
    inner = nodes.feature >= 0
    assert np.array_equal(again.left[inner], nodes.left[inner]) and np.array_equal(again.value[~inner], nodes.value[~inner])


def test_clustering_reads_its_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(v):
        seen.add(1)
        return float(v % 3 * 50 + v % 7)

    df = spark.range(90).select("id", watched("id").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    found = clustering.train_clustering(df, ["a", "b"], ["id"])
    assert found.trained and found.n_samples == 90 and found.labels.select("cluster").distinct().count() == found.best_k
    assert seen.value <= 90


def test_training_reads_its_table_a_few_times(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(v):
        seen.add(1)
        return float(v) * 3 + float(v) % 7

    df = spark.range(200).select("id", (F.col("id") % 50).cast("double").alias("a"), watched("id").alias("y"))
    assert supervised.train_regression(df, "y", ["a"], ["id"], Settings(forest_trees=2), importance=False).trained
    assert seen.value <= 600


def test_dispatched_models_train_side_by_side(spark, monkeypatch):
    from catalog import models, registry

    met = threading.Barrier(4, timeout=60)
    untrained = lambda kind: clustering.ClusterResult(False) if kind == "clustering" else supervised.ModelResult(kind, False)
    monkeypatch.setattr(models, "select_and_train", lambda df, plan, key, settings: (met.wait(), untrained(plan["problem_type"]))[1])
    out = registry.QUERIES["e18_dispatch"](spark, "/root/testdata/sf0.001").collect()
    assert [r["problem_type"] for r in out] == ["regression", "classification", "clustering", "descriptive"]
