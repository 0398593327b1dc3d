"""Prediction models on feature tables.

Forests and boosted regressors come from Spark ML; boosting of all classes in one model, support vectors and networks are fitted here, by sums that Spark makes. The RBF kernel is approximated by a map to
random Fourier features.
"""

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from commitlore.operators import boosting, descent, features as ft, metrics
from commitlore.operators.filters import MIN_ROWS, class_size_guard, min_rows_guard, numeric_columns
from commitlore.schema import DMM_COLUMNS
from commitlore.session import reused, stage

# Seeds, shares, folds, forest sizes, layers and lengths of the reports.
SEED = 42
TEST_SHARE = 0.2
FOLDS = 5
TREES = 100
ROUNDS = 100
ITERATIONS = 100
HOLDOUT_LAYERS = [100, 50]
CV_LAYERS = [64, 128, 64]
TOP_FEATURES = 10

RBF_FEATURES = 128


def rbf_map(size: int, gamma: float, features: int = RBF_FEATURES, seed: int = SEED):
    """The function from a matrix x to random Fourier features sqrt(2/D) cos(Wx + b) of the kernel exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2 * gamma), (size, features))
    b = rng.uniform(0.0, 2 * np.pi, features)
    return lambda x: np.sqrt(2.0 / features) * np.cos(x @ w + b)


def rbf_features(df: DataFrame, inputs: str, output: str, size: int, gamma: float, features: int = RBF_FEATURES, seed: int = SEED) -> DataFrame:
    """`rbf_map` of a column of vectors."""
    made = rbf_map(size, gamma, features, seed)

    @F.pandas_udf("array<double>")
    def mapped(x: pd.Series) -> pd.Series:
        m = np.asarray([np.asarray(v, dtype=float) for v in x]).reshape(-1, size)
        return pd.Series(list(made(m)))

    return df.withColumn(output, array_to_vector(mapped(vector_to_array(F.col(inputs)))))


def model_inputs(df: DataFrame, exclude) -> list[str]:
    """Numeric columns that are neither the target nor derived from it."""
    return [c for c in numeric_columns(df) if c not in set(exclude)]


def _scaled(train: DataFrame, test: DataFrame):
    """Both parts standardised by the training part, in column `scaled`."""
    model = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled").fit(train)
    return model.transform(train), model.transform(test)


def _importances(model, inputs) -> list[tuple[str, float]]:
    if not hasattr(model, "featureImportances"):
        return []
    return [(c, float(v)) for c, v in zip(inputs, model.featureImportances.toArray())]


def fit_regressors(
    train: DataFrame, test: DataFrame, inputs, trees: int = TREES, rounds: int = ROUNDS, iterations: int = ITERATIONS, layers=HOLDOUT_LAYERS,
):
    """Yields (model name, predictions on test, importances)."""
    for name, estimator in [
        ("RandomForest", RandomForestRegressor(numTrees=trees, seed=SEED, labelCol="label")),
        ("GradientBoosting", GBTRegressor(maxIter=rounds, maxDepth=3, seed=SEED, labelCol="label")),
    ]:
        model = estimator.fit(train)
        yield name, model.transform(test).select("label", "prediction"), _importances(model, inputs)
    a, b = _scaled(train, test)
    with descent.held_rows(a, "scaled", "label") as rows:
        svm = descent.fit_tube(rows, RBF_FEATURES, iterations, "scaled", kernel=rbf_map(len(inputs), 1.0 / len(inputs)))
        yield "SVM", descent.predictions(b, svm, "scaled").select("label", "prediction"), []
        network = descent.fit_perceptron(rows, len(inputs), layers, iterations)
        yield "MLP", descent.predictions(b, network, "scaled").select("label", "prediction"), []


def fit_classifiers(
    train: DataFrame, test: DataFrame, inputs, classes: int, trees: int = TREES, rounds: int = ROUNDS, iterations: int = ITERATIONS,
    layers=HOLDOUT_LAYERS, only=None,
):
    """Yields (model name, predictions on test, importances)."""
    wanted = set(only or ["RandomForest", "GradientBoosting", "SVM", "MLP"])
    if "RandomForest" in wanted:
        model = RandomForestClassifier(numTrees=trees, seed=SEED, labelCol="label").fit(train)
        yield "RandomForest", model.transform(test).select("label", "prediction"), _importances(model, inputs)
    if "GradientBoosting" in wanted:
        boosted = boosting.fit_boosted(train, len(inputs), classes, rounds)
        yield "GradientBoosting", boosting.boosted_predictions(test, boosted).select("label", "prediction"), list(zip(inputs, boosted.importances))
    if not wanted & {"SVM", "MLP"}:
        return
    a, b = _scaled(train, test)
    with descent.held_rows(a, "scaled", "label") as rows:
        if "SVM" in wanted:
            svm = descent.fit_margins(rows, RBF_FEATURES, classes, iterations, "scaled", kernel=rbf_map(len(inputs), 1.0 / len(inputs)))
            yield "SVM", descent.predictions(b, svm, "scaled").select("label", "prediction"), []
        if "MLP" in wanted:
            network = descent.fit_perceptron_classes(rows, len(inputs), layers, classes, iterations)
            yield "MLP", descent.predictions(b, network, "scaled").select("label", "prediction"), []


def _none_scored(session, score) -> DataFrame:
    """The table of scores of no model: the columns of `score`, no rows."""
    predicted = session.createDataFrame([], "label double, prediction double")
    return _named(score(predicted), "", "").filter(F.lit(False))


def _tables(session, scores, importances, limit, score):
    """One table of scores, made by `score`, and one of the leading importances per task and model."""
    top = []
    for (task, model), values in importances.items():
        ranked = sorted(values, key=lambda v: (-v[1], v[0]))[:limit]
        top += [(task, model, i + 1, c, v) for i, (c, v) in enumerate(ranked)]
    return {
        "scores": metrics.union_all(scores) if scores else _none_scored(session, score),
        "importances": session.createDataFrame(top, "task string, model string, rank int, feature string, importance double"),
    }


def _skipped(session, reasons) -> DataFrame:
    return session.createDataFrame(reasons, "task string, reason string")


def _prepared(df: DataFrame, target: str, exclude, key: str, label) -> tuple[DataFrame, list[str]]:
    """(key, label, features) of the complete rows, and the names of the inputs."""
    inputs = [c for c in model_inputs(df, [target, *exclude]) if c != key]
    full = df.dropna(subset=[target, *inputs])
    vectors = VectorAssembler(inputCols=inputs, outputCol="features").transform(full)
    return vectors.select(key, label.alias("label"), "features"), inputs


def train_regressors(
    df: DataFrame, key: str = "hash", targets=DMM_COLUMNS, trees: int = TREES, rounds: int = ROUNDS, iterations: int = ITERATIONS,
) -> dict[str, DataFrame]:
    """Hold-out scores of four regressors per target."""
    session = df.sparkSession
    scores, importances, skipped = [], {}, []
    for target in [t for t in targets if t in df.columns]:
        data, inputs = _prepared(df, target, DMM_COLUMNS, key, F.col(target).cast("double"))
        reason = min_rows_guard(data, MIN_ROWS)
        if reason:
            skipped.append((target, reason))
            continue
        with reused(ft.train_test_split(data, key, TEST_SHARE, SEED)) as split:
            train, test = split.filter("not is_test"), split.filter("is_test")
            for name, predicted, weights in fit_regressors(train, test, inputs, trees, rounds, iterations):
                scores.append(stage(_named(metrics.regression_metrics(predicted), target, name)))
                if weights:
                    importances[(target, name)] = weights
    return {**_tables(session, scores, importances, TOP_FEATURES, metrics.regression_metrics), "skipped": _skipped(session, skipped)}


def _named(scores: DataFrame, task: str, model: str) -> DataFrame:
    return scores.select(F.lit(task).alias("task"), F.lit(model).alias("model"), "*")


def indexed_label(df: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    """Adds `label_index`, the rank of the class name, and returns the class names."""
    text = df.withColumn("_text", F.col(label).cast("string"))
    model = StringIndexer(inputCol="_text", outputCol="label_index", stringOrderType="alphabetAsc").fit(text)
    return model.transform(text).drop("_text"), list(model.labels)


def train_classifiers(
    df: DataFrame, label: str, key: str = "hash", exclude=(), trees: int = TREES, rounds: int = ROUNDS, iterations: int = ITERATIONS, only=None,
) -> dict[str, DataFrame]:
    """Hold-out scores of four classifiers of one label, split alike in every class."""
    session = df.sparkSession
    known = df.filter(F.col(label).isNotNull())
    reason = class_size_guard(known, label)
    if reason:
        return {
            **_tables(session, [], {}, TOP_FEATURES, metrics.classification_metrics),
            "confusion": session.createDataFrame([], "task string, model string, actual double, predicted double, rows long"),
            "classes": session.createDataFrame([], "label int, class string"),
            "skipped": _skipped(session, [(label, reason)]),
        }
    indexed, classes = indexed_label(known, label)
    data, inputs = _prepared(indexed.drop(label) if label in exclude else indexed, "label_index", [label, *exclude], key, F.col("label_index"))
    scores, importances, matrices = [], {}, []
    with reused(ft.train_test_split(data, key, TEST_SHARE, SEED, label="label")) as split:
        train, test = split.filter("not is_test"), split.filter("is_test")
        for name, predicted, weights in fit_classifiers(train, test, inputs, len(classes), trees, rounds, iterations, only=only):
            predicted = stage(predicted)
            scores.append(stage(_named(metrics.classification_metrics(predicted), label, name)))
            matrices.append(_named(metrics.confusion_matrix(predicted), label, name))
            if weights:
                importances[(label, name)] = weights
    return {
        **_tables(session, scores, importances, TOP_FEATURES, metrics.classification_metrics),
        "confusion": metrics.union_all(matrices),
        "classes": session.createDataFrame(list(enumerate(classes)), "label int, class string"),
        "skipped": _skipped(session, []),
    }


def predict_quality_class(df: DataFrame, target: str = "dmm_unit_complexity", **options) -> dict[str, DataFrame]:
    """low / medium / high of a metric by its quartiles, from everything but the metrics."""
    labelled = ft.quartile_label(df, target, f"{target}_class")
    return train_classifiers(labelled, f"{target}_class", exclude=DMM_COLUMNS, **options)


def predict_file_type(df: DataFrame, **options) -> dict[str, DataFrame]:
    return train_classifiers(df, "main_file_type", **options)


def predict_change_type(df: DataFrame, **options) -> dict[str, DataFrame]:
    return train_classifiers(df, "main_change_type", **options)


# --- cross-validation ----------------------------------------------------------


def _not_validated(session, task, reason, score) -> dict[str, DataFrame]:
    out = _tables(session, [], {}, TOP_FEATURES, score)
    folds = out["scores"].withColumn("fold", F.lit(0))
    return {"folds": folds, "scores": metrics.fold_summary(folds), "importances": out["importances"], "skipped": _skipped(session, [(task, reason)])}


def _cross_validated(data: DataFrame, key, task, folds, fit, score):
    """Scores per fold, and importances averaged over the folds."""
    scores, sums = [], {}
    with reused(ft.kfold(data, key, folds, SEED)) as table:
        for fold in range(folds):
            train, test = table.filter(F.col("fold") != fold), table.filter(F.col("fold") == fold)
            for name, predicted, weights in fit(train, test):
                row = _named(score(predicted), task, name).withColumn("fold", F.lit(fold))
                scores.append(stage(row))
                for c, v in weights:
                    sums.setdefault((task, name), {}).setdefault(c, []).append(v)
    importances = {k: [(c, float(np.mean(v))) for c, v in w.items()] for k, w in sums.items()}
    out = _tables(data.sparkSession, scores, importances, TOP_FEATURES, score)
    return {"folds": out["scores"], "scores": metrics.fold_summary(out["scores"]), "importances": out["importances"]}


def cv_regression(
    df: DataFrame, target: str = "dmm_score", key: str = "hash", folds: int = FOLDS, trees: int = TREES, rounds: int = ROUNDS, iterations: int = ITERATIONS,
) -> dict[str, DataFrame]:
    """Cross-validated scores of four regressors of the DMM score."""
    data, inputs = _prepared(df, target, [*DMM_COLUMNS, "dmm_score"], key, F.col(target).cast("double"))
    reason = min_rows_guard(data, MIN_ROWS)
    if reason:
        return _not_validated(df.sparkSession, target, reason, metrics.regression_metrics)
    return _cross_validated(
        data, key, target, folds, lambda a, b: fit_regressors(a, b, inputs, trees, rounds, iterations, CV_LAYERS), metrics.regression_metrics
    )


def cv_classification(
    df: DataFrame, label: str = "dmm_risk_level", key: str = "hash", folds: int = FOLDS, trees: int = TREES, rounds: int = ROUNDS, iterations: int = ITERATIONS,
    exclude=(*DMM_COLUMNS, "dmm_score"),
) -> dict[str, DataFrame]:
    """Cross-validated scores of four classifiers of the risk level."""
    def score(predicted):
        kept = ["accuracy", "weighted_precision", "weighted_recall", "weighted_f1"]
        return metrics.classification_metrics(predicted).select(*kept)

    known = df.filter(F.col(label).isNotNull())
    reason = min_rows_guard(known, MIN_ROWS) or class_size_guard(known, label)
    if reason:
        return _not_validated(df.sparkSession, label, reason, score)
    indexed, classes = indexed_label(known, label)
    data, inputs = _prepared(indexed, "label_index", [label, *exclude], key, F.col("label_index"))

    return _cross_validated(
        data, key, label, folds, lambda a, b: fit_classifiers(a, b, inputs, len(classes), trees, rounds, iterations, CV_LAYERS), score
    )
