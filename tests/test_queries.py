"""Every query with SQL against DuckDB, and the others for rows and columns."""

import pytest

import __spark_entry__ as entry_module
from tools.check_queries import compare, connect

SLOW = {
    "kmeans_sweep", "kmeans_commit_sizes", "train_regressors", "feature_importance", "predict_quality_class",
    "predict_file_type", "predict_change_type", "cv_regression", "cv_classification", "file_impact",
    "analyze_commits", "graph_communities",
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_matches_sql(spark, con, sf_dir, name):
    ok, message = compare(spark, con, name, sf_dir)
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(entry_module.queries()) - set(entry_module.oracle_sql()) - SLOW))
def test_gives_rows(spark, sf_dir, name):
    df = entry_module.queries()[name](spark, sf_dir)
    assert df.columns and not df.isEmpty()


@pytest.mark.parametrize("name", ["feature_importance", "graph_communities"])
def test_slow_query_gives_rows(spark, sf_dir, name):
    assert not entry_module.queries()[name](spark, sf_dir).isEmpty()


def test_entry(spark):
    row = entry_module.entry(spark).first()
    assert sum(row) == 1500


def test_every_sql_has_its_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", [
    "co_change_pairs", "frequent_itemsets", "similarity_graph", "silhouette_rows", "confusion_matrix", "quality_score_bands",
    "filter_by_repo_config", "churn_scatter", "label_encode", "cumulative_churn",
])
def test_plan_has_no_cross_join(spark, sf_dir, name):
    plan = entry_module.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_is_needed(spark, sf_dir):
    plan = entry_module.queries()["monthly_commits"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "o_totalprice" not in plan
    plan = entry_module.queries()["drop_empty_dmm"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "customer" not in plan and "l_extendedprice" not in plan
