import os

import pytest

import __spark_entry__ as entry
from catalog.compare import compare

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")

SOME = [
    "a5_normalise_columns", "b4_duplicate_rows", "c12_dataset_profile", "d1_correlation_analysis", "d4_flag_outliers",
    "d14_moving_average", "d19_anova", "e8_stratified_folds", "f3_feature_sentences", "g3_bootstrap_stability", "h4_report_text",
]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    assert compare(spark, SMALL, entry.queries(), entry.oracle_sql(), [name]) == []


def test_every_comparison_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 28 and "p_value" in df.columns


def plan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_scans_are_pruned_and_filters_pushed(spark):
    from assay.operators.segments import segment_moments

    orders = spark.read.parquet(f"{SMALL}/orders.parquet").where("o_totalprice > 1000")
    plan = plan_of(segment_moments(orders, "o_orderstatus", "o_totalprice"))
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in plan
    assert "GreaterThan(o_totalprice,1000.0)" in plan


@pytest.mark.parametrize("name", ["b4_duplicate_rows", "d12_histogram", "d14_moving_average", "g3_bootstrap_correlations", "e8_stratified_folds"])
def test_no_query_pairs_all_rows(spark, name):
    plan = plan_of(entry.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
