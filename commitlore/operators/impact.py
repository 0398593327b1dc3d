"""Which files a file drags along, and models that foresee it."""

from pyspark.sql import DataFrame, functions as F

from commitlore.functions.numbers import histogram_bin
from commitlore.functions.text import strip_set_repr
from commitlore.operators import features as ft, metrics, models
from commitlore.operators.filters import class_size_guard, min_rows_guard
from commitlore.session import reused, stage

# Files listed, lengths of the reports.
INFLUENCED_FILES = 10
TOP_FEATURES = 5
SUMMARY_FEATURES = 8
ACCURACY_BINS = 10


def printed_rules(rules: DataFrame) -> DataFrame:
    """Rules as (source, target) texts like {'a.py', 'b.py'}."""
    def shown(c):
        return F.concat(F.lit("{'"), F.concat_ws("', '", c), F.lit("'}"))

    return rules.select(shown("antecedents").alias("source"), shown("consequents").alias("target"))


def influenced_files(rules: DataFrame, target_file: str, limit: int | None = INFLUENCED_FILES, regex: bool = False) -> DataFrame:
    """Single-file targets of the rules whose source names the file, the first `limit` or all."""
    names_it = F.col("source").rlike(target_file) if regex else F.col("source").contains(target_file)
    clean = strip_set_repr("target")
    found = rules.filter(names_it & ~F.col("target").contains(target_file) & ~clean.contains(",")).select(clean.alias("file")).distinct().orderBy("file")
    return found if limit is None else found.limit(limit)


def impact_labels(commits: DataFrame, file_changes: DataFrame, target_file: str, file: str, column: str = "filename") -> DataFrame:
    """Adds touches_target, touches_file and label, 1 where a commit touches both."""
    wanted = file_changes.filter(F.col(column).isin(target_file, file))
    touched = wanted.groupBy("hash").agg(
        F.max(F.when(F.col(column) == target_file, 1).otherwise(0)).alias("touches_target"),
        F.max(F.when(F.col(column) == file, 1).otherwise(0)).alias("touches_file"),
    )
    joined = commits.join(touched, "hash", "left").fillna(0, ["touches_target", "touches_file"])
    return joined.withColumn("label", F.col("touches_target") * F.col("touches_file"))


def file_impact(
    feature_rows: DataFrame, file_changes: DataFrame, rules: DataFrame, target_file: str,
    trees: int = models.TREES, rounds: int = models.ROUNDS, iterations: int = models.ITERATIONS, max_models: int | None = None,
) -> dict[str, DataFrame]:
    """Models that tell, for commits touching the target, whether an influenced file goes along: of all such files, or the first `max_models`."""
    session = feature_rows.sparkSession
    files = stage(influenced_files(rules, target_file, limit=None))
    scores, importances, skipped = [], {}, []
    inputs = [c for c in models.model_inputs(feature_rows, []) if c != "hash"]
    # a name for each set of fits; rules are few
    for file in sorted(r["file"] for r in files.collect())[:max_models]:
        rows = impact_labels(feature_rows, file_changes, target_file, file).filter("touches_target = 1").fillna(0, inputs)
        reason = min_rows_guard(rows) or class_size_guard(rows, "label")
        if reason:
            skipped.append((file, reason))
            continue
        data, _ = models._prepared(
            rows.drop("touches_target", "touches_file"), "label", [], "hash", F.col("label").cast("double")
        )
        with reused(ft.train_test_split(data, "hash", models.TEST_SHARE, models.SEED, label="label")) as split:
            train, test = split.filter("not is_test"), split.filter("is_test")
            fitted = models.fit_classifiers(
                train, test, inputs, 2, trees, rounds, iterations, only=["RandomForest", "GradientBoosting", "SVM"]
            )
            for name, predicted, weights in fitted:
                scores.append(stage(models._named(metrics.binary_metrics(predicted), file, name)))
                if weights:
                    importances[(file, name)] = weights
    out = models._tables(session, scores, importances, TOP_FEATURES, metrics.binary_metrics)
    return {**out, "influenced": files, "skipped": models._skipped(session, skipped)}


def mean_f1_by_model(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(F.avg("f1").alias("mean_f1"), F.count("f1").alias("models"))


def mean_importance(importances: DataFrame, limit: int = SUMMARY_FEATURES) -> DataFrame:
    return (
        importances.groupBy("feature").agg(F.avg("importance").alias("mean_importance"))
        .orderBy(F.desc(F.round("mean_importance", 12)), "feature").limit(limit)
    )


def accuracy_histogram(scores: DataFrame, bins: int = ACCURACY_BINS) -> DataFrame:
    """Models per equal-width accuracy bin."""
    bounds = scores.agg(F.struct(F.min("accuracy").alias("lo"), F.max("accuracy").alias("hi")))
    placed = scores.filter("accuracy is not null").withColumn("_b", bounds.scalar())
    return placed.groupBy(histogram_bin("accuracy", F.col("_b.lo"), F.col("_b.hi"), bins).alias("bin")).agg(
        F.count("*").alias("models")
    )


def file_impact_summary(scores: DataFrame, importances: DataFrame) -> dict[str, DataFrame]:
    return {
        "mean_f1": mean_f1_by_model(scores),
        "mean_importance": mean_importance(importances),
        "accuracy_histogram": accuracy_histogram(scores),
        "mean_accuracy": scores.agg(F.avg("accuracy").alias("mean_accuracy")),
    }
