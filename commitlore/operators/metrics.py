"""Scores of predictions, from (label, prediction) columns."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def regression_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """mse, mae, r2_score and rmse in one pass."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    sums = predictions.agg(
        F.avg(F.pow(y - p, F.lit(2))).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("spread"),
    )
    r2 = F.when(F.col("spread") > 0, 1 - F.col("mse") / F.col("spread")).otherwise(
        F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    )
    return sums.select("mse", "mae", r2.alias("r2_score"), F.sqrt("mse").alias("rmse"))


def _pair_counts(predictions, label, prediction):
    return predictions.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count("*").alias("rows")
    )


def class_report(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """precision, recall, f1 and support per class; a division by zero gives 0.

    Everything follows from the counts per (label, prediction), summed where the rows are.
    """
    counts = _pair_counts(predictions, label, prediction)
    # each count enters the sums of its actual and of its predicted class
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("actual").alias("class"), F.col("rows").alias("support"), F.lit(0).cast("long").alias("claimed"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("rows")).otherwise(0).alias("hits")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("rows").alias("claimed"),
                 F.lit(0).cast("long").alias("hits")),
    )).alias("s")).select("s.*")
    sums = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "claimed", "hits")])
    precision = F.coalesce(F.try_divide("hits", "claimed"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("claimed") + F.col("support")), F.lit(0.0))
    return sums.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def classification_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy, and precision, recall and f1 as plain and as support-weighted means."""
    report = class_report(predictions, label, prediction)
    names = ["precision", "recall", "f1"]
    weighted = [(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}") for m in names]
    # recall weighted by support is the share of hits
    accuracy = (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy")
    return report.agg(accuracy, *[F.avg(m).alias(f"macro_{m}") for m in names], *weighted)


def binary_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy, and precision, recall and f1 of class 1."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    n = predictions.agg(
        F.avg((y == p).cast("double")).alias("accuracy"), F.count_if(y & p).alias("hits"),
        F.count_if(y).alias("support"), F.count_if(p).alias("claimed"),
    )
    return n.select(
        "accuracy",
        F.coalesce(F.try_divide("hits", "claimed"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("hits", "support"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("hits"), F.col("claimed") + F.col("support")), F.lit(0.0)).alias("f1"),
    )


def confusion_matrix(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, rows) for every pair of classes, 0 where none."""
    counts = _pair_counts(predictions, label, prediction)
    classes = counts.select(F.explode(F.array("actual", "predicted")).alias("c")).agg(
        F.sort_array(F.collect_set("c"))
    )
    by_actual = counts.groupBy("actual").agg(F.map_from_entries(F.collect_list(F.struct("predicted", "rows"))).alias("found"))
    actual = counts.select(F.explode(F.array("actual", "predicted")).alias("actual")).distinct().join(by_actual, "actual", "left")
    filled = actual.withColumn("predicted", F.explode(classes.scalar()))
    value = F.coalesce(F.try_element_at("found", F.col("predicted")), F.lit(0)).cast("long")
    return filled.select("actual", "predicted", value.alias("rows"))


def model_scoreboard(scores: DataFrame, id_columns=("task", "model")) -> DataFrame:
    """Tidy (task, model, metric, value) rows of a table with one column per metric."""
    metrics = [c for c in scores.columns if c not in id_columns]
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return scores.select(*id_columns, F.explode(F.array(*pairs)).alias("s")).select(*id_columns, "s.*").filter(
        "value is not null"
    )


def fold_summary(scores: DataFrame, id_columns=("task", "model")) -> DataFrame:
    """Mean and population std of each metric over the folds."""
    metrics = [c for c in scores.columns if c not in (*id_columns, "fold")]
    return scores.groupBy(*id_columns).agg(
        *[F.avg(m).alias(f"avg_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"std_{m}") for m in metrics]
    )


def best_model(scores: DataFrame, metric: str = "avg_r2_score") -> DataFrame:
    """The model with the largest score; a tie goes to the first name."""
    return scores.filter(F.col(metric).isNotNull()).orderBy(F.desc(metric), "model").limit(1).select("model", metric)


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
