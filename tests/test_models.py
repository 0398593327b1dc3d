"""Models and their scores."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from commitlore.operators import impact, metrics, models
from commitlore.plans import reports

FAST = {"trees": 5, "rounds": 2, "iterations": 10}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, 3))
    data = pd.DataFrame(x, columns=["a", "b", "c"])
    data["hash"] = [str(i) for i in range(300)]
    data["dmm_unit_size"] = 2 * x[:, 0] + 0.1 * rng.normal(0, 1, 300)
    data["dmm_unit_complexity"] = data["dmm_unit_size"]
    data["dmm_unit_interfacing"] = data["dmm_unit_size"]
    data["kind"] = np.where(x[:, 0] > 0.5, "z", np.where(x[:, 1] > 0, "y", "x"))
    return spark.createDataFrame(data)


def test_regressors_learn(table):
    found = models.train_regressors(table, targets=["dmm_unit_size"], **FAST)
    r2 = {r["model"]: r["r2_score"] for r in found["scores"].collect()}
    assert set(r2) == {"RandomForest", "GradientBoosting", "SVM", "MLP"}
    assert r2["RandomForest"] > 0.7 and r2["SVM"] > 0.5
    top = found["importances"].filter("rank = 1").collect()
    assert {r["feature"] for r in top} == {"a"}


def test_classifiers_learn(table):
    found = models.train_classifiers(table, "kind", exclude=["dmm_unit_size", "dmm_unit_complexity", "dmm_unit_interfacing"], **FAST)
    accuracy = {r["model"]: r["accuracy"] for r in found["scores"].collect()}
    assert set(accuracy) == {"RandomForest", "GradientBoosting", "SVM", "MLP"} and min(accuracy.values()) > 0.5
    assert found["confusion"].count() == 4 * 9
    assert [r["class"] for r in found["classes"].orderBy("label").collect()] == ["x", "y", "z"]


def test_cross_validation(table):
    found = models.cv_regression(table.withColumn("dmm_score", F.col("dmm_unit_size")), folds=2, **FAST)
    assert found["folds"].count() == 8 and found["scores"].count() == 4
    assert metrics.best_model(found["scores"]).first()["avg_r2_score"] > 0.5


def test_reasons_not_to_train(spark, table):
    few = table.limit(5)
    assert models.train_regressors(few, **FAST)["skipped"].count() == 3
    one = table.withColumn("kind", F.lit("same"))
    assert models.train_classifiers(one, "kind", **FAST)["skipped"].first()["reason"] == "only one class"
    assert "skipped" in models.cv_regression(few.withColumn("dmm_score", F.col("a")), **FAST)


def test_kernel_of_random_features(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(1)
    data = rng.normal(0, 1, (20, 4))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "i int, v array<double>")
    mapped = models.rbf_features(df.withColumn("v", array_to_vector("v")), "v", "r", 4, 0.25, features=4096)
    m = np.array([r["r"] for r in mapped.orderBy("i").select(vector_to_array("r").alias("r")).collect()])
    exact = np.exp(-0.25 * ((data[:, None] - data[None]) ** 2).sum(-1))
    assert np.abs(m @ m.T - exact).max() < 0.1


def test_scores_by_hand(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(pairs, "label string, prediction string")
    report = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert report["a"]["precision"] == 0.5 and report["a"]["recall"] == 0.5 and report["c"]["f1"] == 0.0
    assert metrics.classification_metrics(df).first()["accuracy"] == pytest.approx(0.6)
    matrix = {(r["actual"], r["predicted"]): r["rows"] for r in metrics.confusion_matrix(df).collect()}
    assert len(matrix) == 9 and sum(matrix.values()) == 5 and matrix[("c", "c")] == 0


def test_impact_of_a_file(spark, table):
    rows = [(str(i), "t.py") for i in range(300)] + [(str(i), "u.py") for i in range(0, 300, 3)]
    changes = spark.createDataFrame(rows, "hash string, filename string")
    rules = spark.createDataFrame([("{'t.py'}", "{'u.py'}"), ("{'t.py'}", "{'v.py'}")], "source string, target string")
    found = impact.file_impact(table.drop("kind"), changes, rules, "t.py", **FAST)
    assert [r["file"] for r in found["influenced"].collect()] == ["u.py", "v.py"]
    assert found["scores"].count() == 3 and found["skipped"].first()["task"] == "v.py"
    summary = impact.file_impact_summary(found["scores"], found["importances"])
    assert summary["mean_f1"].count() == 3 and summary["mean_importance"].count() == 6


def test_impact_on_every_influenced_file(spark, table, monkeypatch):
    names = [f"u{k:02d}.py" for k in range(12)]
    changes = spark.createDataFrame([("1", "t.py")], "hash string, filename string")
    rules = spark.createDataFrame([("{'t.py'}", f"{{'{name}'}}") for name in names], "source string, target string")
    monkeypatch.setattr(impact, "min_rows_guard", lambda rows: "asked for")
    found = impact.file_impact(table.drop("kind"), changes, rules, "t.py")
    assert [r["task"] for r in found["skipped"].orderBy("task").collect()] == names == [r["file"] for r in found["influenced"].orderBy("file").collect()]
    assert [r["file"] for r in impact.influenced_files(rules, "t.py").collect()] == names[:10]


def test_reports_leave_out_what_they_cannot_do(spark):
    bare = spark.createDataFrame([("1", "x")], "hash string, author string")
    assert set(reports.activity_report(bare, profile_clusters=False)) == {"top_authors"}
    assert reports.quality_report(bare) == {}
    assert "error" in reports.risk_report(bare)
