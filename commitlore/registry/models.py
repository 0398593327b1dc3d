"""Prediction models and their scores.

Models are those of the library's defaults, on all rows; only `feature_importance` has fewer trees, to keep a run over all
queries short.
"""

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from commitlore.operators import baskets, features, impact, metrics, models
from commitlore.registry.base import COMMITS, FILE_CHANGES, query, rounded
from commitlore.registry.baskets import _rules, _rules_sql
from commitlore.schema import DMM_COLUMNS, SIZE_COLUMNS
from commitlore.session import stage
from commitlore.sources.sample_views import VIEW_COLUMNS, commits, file_changes, table

_FAST = {"trees": 10}

# --- scores of given predictions -----------------------------------------------


def _number_predictions(spark, sf_dir):
    df = commits(spark, sf_dir, "dmm_unit_size", "dmm_unit_interfacing").dropna()
    return df.withColumnsRenamed({"dmm_unit_size": "label", "dmm_unit_interfacing": "prediction"})


def _class_predictions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 4).alias("label"), (F.col("o_custkey") % 5).alias("prediction")
    )


_GUESSED = "g AS (SELECT o_orderkey % 4 AS label, o_custkey % 5 AS prediction FROM orders)"
_REPORT = f"""{_GUESSED},
c AS (SELECT unnest(range(0, 5)) AS class),
r AS (SELECT class, (SELECT count(*) FROM g WHERE label = class AND prediction = class) AS hits,
             (SELECT count(*) FROM g WHERE label = class) AS support, (SELECT count(*) FROM g WHERE prediction = class) AS claimed FROM c),
report AS (SELECT class, hits, support, coalesce(hits / nullif(claimed, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
             coalesce(2 * hits / nullif(claimed + support, 0), 0) AS f1 FROM r)"""


@query("regression_metrics", f"""WITH {COMMITS},
g AS (SELECT dmm_unit_size AS y, dmm_unit_interfacing AS p FROM commits WHERE dmm_unit_size IS NOT NULL)
SELECT round(avg((y - p) ^ 2), 6) AS mse, round(avg(abs(y - p)), 6) AS mae,
       round(1 - sum((y - p) ^ 2) / sum((y - (SELECT avg(y) FROM g)) ^ 2), 6) AS r2_score, round(sqrt(avg((y - p) ^ 2)), 6) AS rmse FROM g""")
def regression_metrics(spark, sf_dir):
    return rounded(metrics.regression_metrics(_number_predictions(spark, sf_dir)), "mse", "mae", "r2_score", "rmse")


@query("class_report", f"""WITH {_REPORT}
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report""")
def class_report(spark, sf_dir):
    return rounded(metrics.class_report(_class_predictions(spark, sf_dir)), "precision", "recall", "f1")


_AVERAGES = [f"{kind}_{m}" for kind in ("macro", "weighted") for m in ("precision", "recall", "f1")]


@query("classification_metrics", f"""WITH {_REPORT}
SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall,
       round(avg(f1), 6) AS macro_f1, round(sum(precision * support) / sum(support), 6) AS weighted_precision,
       round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM report""")
def classification_metrics(spark, sf_dir):
    return rounded(metrics.classification_metrics(_class_predictions(spark, sf_dir)), "accuracy", *_AVERAGES)


@query("binary_metrics", """WITH g AS (SELECT o_orderkey % 3 = 1 AS y, o_custkey % 2 = 1 AS p FROM orders)
SELECT round(avg((y = p)::int), 6) AS accuracy, round(count(*) FILTER (y AND p) / count(*) FILTER (p), 6) AS precision,
       round(count(*) FILTER (y AND p) / count(*) FILTER (y), 6) AS recall,
       round(2 * count(*) FILTER (y AND p) / (count(*) FILTER (y) + count(*) FILTER (p)), 6) AS f1 FROM g""")
def binary_metrics(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3).alias("label"), (F.col("o_custkey") % 2).alias("prediction"))
    return rounded(metrics.binary_metrics(df), "accuracy", "precision", "recall", "f1")


@query("confusion_matrix", f"""WITH {_GUESSED}, c AS (SELECT unnest(range(0, 5)) AS k),
n AS (SELECT label, prediction, count(*) AS n FROM g GROUP BY 1, 2)
SELECT a.k AS actual, b.k AS predicted, coalesce(n, 0) AS "rows" FROM c a CROSS JOIN c b LEFT JOIN n ON label = a.k AND prediction = b.k""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_class_predictions(spark, sf_dir))


def _project_scores(spark, sf_dir):
    """Per project and branch the scores of one given prediction, as if each were a model."""
    df = commits(spark, sf_dir, "project_name", "branches", "dmm_unit_size", "dmm_unit_complexity").dropna()
    return df.groupBy(F.col("project_name").alias("task"), F.col("branches").alias("model")).agg(
        F.avg(F.abs(F.col("dmm_unit_size") - F.col("dmm_unit_complexity"))).alias("mae"),
        F.avg((F.round("dmm_unit_size", 1) == F.round("dmm_unit_complexity", 1)).cast("double")).alias("accuracy"),
        F.corr("dmm_unit_size", "dmm_unit_complexity").alias("f1"),
    )


_SCORES = f"""{COMMITS},
scores AS (SELECT project_name AS task, branches AS model, avg(abs(dmm_unit_size - dmm_unit_complexity)) AS mae,
  avg((round(dmm_unit_size, 1) = round(dmm_unit_complexity, 1))::int) AS accuracy, corr(dmm_unit_size, dmm_unit_complexity) AS f1
  FROM commits WHERE dmm_unit_size IS NOT NULL GROUP BY 1, 2)"""


@query("model_scoreboard", f"""WITH {_SCORES}
SELECT task, model, metric, round(value, 6) AS value FROM (UNPIVOT scores ON mae, accuracy, f1 INTO NAME metric VALUE value)""")
def model_scoreboard(spark, sf_dir):
    return rounded(metrics.model_scoreboard(_project_scores(spark, sf_dir)), "value")


@query("fold_summary", f"""WITH {_SCORES}
SELECT model, round(avg(mae), 6) AS avg_mae, round(avg(accuracy), 6) AS avg_accuracy, round(stddev_pop(mae), 6) AS std_mae,
       round(stddev_pop(accuracy), 6) AS std_accuracy FROM scores GROUP BY 1""")
def fold_summary(spark, sf_dir):
    scores = _project_scores(spark, sf_dir).select("model", F.col("task").alias("fold"), "mae", "accuracy")
    return rounded(metrics.fold_summary(scores, ("model",)), "avg_mae", "avg_accuracy", "std_mae", "std_accuracy")


@query("best_model", f"""WITH {_SCORES}
SELECT model, avg_accuracy FROM (SELECT model, round(avg(accuracy), 6) AS avg_accuracy FROM scores GROUP BY 1)
ORDER BY avg_accuracy DESC, model LIMIT 1""")
def best_model(spark, sf_dir):
    scores = _project_scores(spark, sf_dir).groupBy("model").agg(F.round(F.avg("accuracy"), 6).alias("avg_accuracy"))
    return metrics.best_model(scores, "avg_accuracy")


@query("mean_f1_by_model", f"WITH {_SCORES} SELECT model, round(avg(f1), 6) AS mean_f1, count(f1) AS models FROM scores GROUP BY 1")
def mean_f1_by_model(spark, sf_dir):
    return rounded(impact.mean_f1_by_model(_project_scores(spark, sf_dir)), "mean_f1")


@query("accuracy_histogram", f"""WITH {_SCORES}, b AS (SELECT min(accuracy) AS lo, (max(accuracy) - min(accuracy)) / 10.0e0 AS w FROM scores)
SELECT cast(least(floor((accuracy - lo) / w), 9) AS int) AS bin, count(*) AS models FROM scores, b GROUP BY 1""")
def accuracy_histogram(spark, sf_dir):
    return impact.accuracy_histogram(_project_scores(spark, sf_dir))


@query("mean_importance", f"""WITH {_SCORES}
SELECT task AS feature, round(avg(mae), 6) AS mean_importance FROM scores GROUP BY 1 ORDER BY round(avg(mae), 12) DESC, 1 LIMIT 8""")
def mean_importance(spark, sf_dir):
    df = _project_scores(spark, sf_dir).select(F.col("task").alias("feature"), F.col("mae").alias("importance"))
    return rounded(impact.mean_importance(df), "mean_importance")


# --- impact --------------------------------------------------------------------

_TARGET = "brand_1.java"


@query("influenced_files", f"""WITH {_rules_sql(0.002)}
SELECT DISTINCT consequents AS file FROM rules WHERE contains(antecedents, '{_TARGET}') AND NOT contains(consequents, '{_TARGET}')
  AND NOT contains(consequents, '|') ORDER BY 1 LIMIT 10""")
def influenced_files(spark, sf_dir):
    return impact.influenced_files(impact.printed_rules(_rules(spark, sf_dir, 0.002)), _TARGET)


@query("impact_labels", f"""WITH {FILE_CHANGES},{COMMITS},
t AS (SELECT hash, max((filename = '{_TARGET}')::int) AS a, max((filename = 'brand_2.md')::int) AS b FROM file_changes GROUP BY 1)
SELECT hash, coalesce(a, 0) AS touches_target, coalesce(b, 0) AS touches_file, coalesce(a * b, 0) AS label FROM commits LEFT JOIN t USING (hash)""")
def impact_labels(spark, sf_dir):
    return impact.impact_labels(commits(spark, sf_dir, "hash"), file_changes(spark, sf_dir), _TARGET, "brand_2.md")


# --- fitted models -------------------------------------------------------------


def _features(spark, sf_dir):
    """The feature table, computed once for all fits."""
    return stage(features.feature_table(stage(commits(spark, sf_dir, *VIEW_COLUMNS)), keep_hash=True))


@query("rbf_features")
def rbf_features(spark, sf_dir):
    df = commits(spark, sf_dir, "hash", *SIZE_COLUMNS)
    vectors = VectorAssembler(inputCols=SIZE_COLUMNS, outputCol="features").transform(df)
    scaled = StandardScaler(withMean=True, inputCol="features", outputCol="scaled").fit(vectors).transform(vectors)
    mapped = models.rbf_features(scaled, "scaled", "rbf", len(SIZE_COLUMNS), 1.0 / len(SIZE_COLUMNS), features=16)
    return mapped.select("hash", F.concat_ws(",", F.transform(vector_to_array("rbf"), lambda x: F.round(x, 6).cast("string"))).alias("rbf"))


@query("train_regressors")
def train_regressors(spark, sf_dir):
    return models.train_regressors(_features(spark, sf_dir))["scores"]


@query("feature_importance")
def feature_importance(spark, sf_dir):
    df = _features(spark, sf_dir)
    return models.train_classifiers(df, "main_change_type", only=["RandomForest"], **_FAST)["importances"]


@query("predict_quality_class")
def predict_quality_class(spark, sf_dir):
    return models.predict_quality_class(_features(spark, sf_dir))["scores"]


@query("predict_file_type")
def predict_file_type(spark, sf_dir):
    return models.predict_file_type(_features(spark, sf_dir))["scores"]


@query("predict_change_type")
def predict_change_type(spark, sf_dir):
    return models.predict_change_type(_features(spark, sf_dir))["confusion"]


@query("cv_regression")
def cv_regression(spark, sf_dir):
    df = features.dmm_score(_features(spark, sf_dir))
    return models.cv_regression(df)["scores"]


@query("cv_classification")
def cv_classification(spark, sf_dir):
    df = features.dmm_score(_features(spark, sf_dir))
    labelled = features.quartile_label(df, "dmm_score", "dmm_risk_level")
    return models.cv_classification(labelled)["scores"]


@query("file_impact")
def file_impact(spark, sf_dir):
    rules = impact.printed_rules(_rules(spark, sf_dir))
    return impact.file_impact(_features(spark, sf_dir), file_changes(spark, sf_dir), rules, _TARGET)["scores"]
