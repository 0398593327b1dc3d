"""Clusterings of feature tables, their evaluation, and principal components."""

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from commitlore.operators import features as ft, lloyd
from commitlore.operators.filters import (
    constant_columns, correlated_columns, exclude_id_like, numeric_columns,
)
from commitlore.session import reused

# The range of cluster numbers, restarts, components, and the fixed profile.
MAX_CLUSTERS = 10
RESTARTS = 10
SEED = 42
COMPONENTS = 3
PROFILE_CLUSTERS = 5
PROFILE_COMPONENTS = 2
TOP_LOADINGS = 10
BALANCE_GUARD = 1e-8


def clustering_columns(df: DataFrame) -> list[str]:
    """Numeric columns without identifiers, constants and near copies of earlier ones."""
    columns = exclude_id_like(numeric_columns(df))
    filled = ft.impute_median(df.select(*columns), columns)
    with reused(filled) as table:
        constant = set(constant_columns(table, columns))
        varying = [c for c in columns if c not in constant]
        redundant = set(correlated_columns(table, varying))
    return [c for c in varying if c not in redundant]


def clustering_features(df: DataFrame, keep=()) -> DataFrame:
    """The chosen columns, median-filled, beside the `keep` columns."""
    columns = [c for c in clustering_columns(df.drop(*keep))]
    return ft.impute_median(df.select(*keep, *columns), columns)


def assembled(df: DataFrame, columns, output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


def as_vectors(df: DataFrame, array_col: str, output: str = "features") -> DataFrame:
    return df.withColumn(output, array_to_vector(F.col(array_col).cast("array<double>")))


# --- k-means -------------------------------------------------------------------


def silhouette_value(clustered: DataFrame, label: str = "prediction", vector: str = "features") -> float | None:
    """Mean silhouette over squared Euclidean distances, in time linear in the rows.

    Sums per cluster stand in for the single distances. None with fewer than two clusters.
    """
    if clustered.select(label).distinct().limit(2).count() < 2:
        return None
    return ClusteringEvaluator(
        predictionCol=label, featuresCol=vector, metricName="silhouette", distanceMeasure="squaredEuclidean",
    ).evaluate(clustered)


def silhouette(clustered: DataFrame, label: str = "prediction", vector: str = "features") -> DataFrame:
    value = silhouette_value(clustered.withColumn(label, F.col(label).cast("double")), label, vector)
    return clustered.sparkSession.createDataFrame([(value,)], "silhouette double")


def kmeans_sweep(vectors: DataFrame, max_clusters: int = MAX_CLUSTERS, restarts: int = RESTARTS, seed: int = SEED) -> dict:
    """Silhouette and inertia for k = 2 .. min(max, rows / 2), and the clustering of the best k.

    All k and restarts go over the rows together, one scan an iteration.
    """
    with reused(vectors.select(vector_to_array("features").alias("x"))) as rows:
        top = min(max_clusters, rows.limit(2 * max_clusters).count() // 2)
        if top < 2:
            return {"error": "too few rows to cluster"}
        fits = lloyd.fit_all(rows, list(range(2, top + 1)), restarts, seed)
        found = lloyd.silhouettes(rows, fits)
    best = max(fits, key=lambda k: (found[k] if found[k] is not None else -2.0, -k))
    session = vectors.sparkSession
    labelled = _labelled(vectors, fits[best][0])
    return {
        "best_k": best,
        "scores": session.createDataFrame([(k, found[k], fits[k][1]) for k in fits], "k int, silhouette double, inertia double"),
        "centers": _centers(session, fits[best][0]),
        "labels": labelled,
        "sizes": cluster_sizes(labelled),
    }


def _labelled(vectors: DataFrame, centers, output: str = "cluster") -> DataFrame:
    return lloyd.labelled(vectors.withColumn("_x", vector_to_array("features")), "_x", centers, output).drop("_x")


def _centers(session, centers) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    return session.createDataFrame(rows, "cluster int, center array<double>")


def cluster_sizes(labelled: DataFrame, label: str = "cluster") -> DataFrame:
    return labelled.groupBy(label).agg(F.count("*").alias("rows"))


def cluster_balance(labelled: DataFrame, label: str = "cluster") -> DataFrame:
    """Entropy of the cluster shares over its maximum; 1 for a single cluster."""
    sizes = cluster_sizes(labelled, label)
    total = sizes.agg(F.sum("rows")).scalar()
    p = F.col("rows") / total
    k = F.count("*")
    entropy = -F.sum(p * F.log2(p + BALANCE_GUARD))
    return sizes.agg(k.alias("n_clusters"), entropy.alias("entropy")).select(
        "n_clusters",
        F.when(F.col("n_clusters") <= 1, 1.0).otherwise(F.col("entropy") / F.log2(F.col("n_clusters"))).alias("balance"),
    )


def cluster_report(labelled: dict[str, DataFrame], label: str = "cluster", vector: str = "features") -> DataFrame:
    """Silhouette, number and balance of the clusters of each method."""
    out = None
    for method, df in labelled.items():
        score = silhouette_value(df.withColumn(label, F.col(label).cast("double")), label, vector)
        row = cluster_balance(df, label).select(
            F.lit(method).alias("method"), F.lit(score).cast("double").alias("silhouette"), "n_clusters", "balance"
        )
        out = row if out is None else out.unionByName(row)
    return out


# --- principal components ------------------------------------------------------


def fit_pca(df: DataFrame, columns, components: int = COMPONENTS):
    """(standardised table with `features`, loadings columns x components, shares of variance).

    Each component is turned so that its largest loading is positive.
    """
    columns = list(columns)
    scaled = assembled(ft.standardize(df, columns), columns)
    model = PCA(k=min(components, len(columns)), inputCol="features", outputCol="pc").fit(scaled)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), range(loadings.shape[1])])
    return scaled, loadings * signs, [float(v) for v in model.explainedVariance.toArray()]


def _projected(scaled: DataFrame, loadings, keep) -> DataFrame:
    """Coordinates as plain sums of products, one column per component."""
    x = vector_to_array("features")
    rows = scaled.withColumn("_x", x)
    coords = []
    for j in range(loadings.shape[1]):
        weights = F.array(*[F.lit(float(w)) for w in loadings[:, j]])
        products = F.zip_with("_x", weights, lambda a, b: a * b)
        coords.append(F.aggregate(products, F.lit(0.0), lambda s, v: s + v).alias(f"pc{j + 1}"))
    return rows.select(*keep, *coords)


def pca_projection(df: DataFrame, columns, keep=(), components: int = COMPONENTS) -> DataFrame:
    scaled, loadings, _ = fit_pca(df, columns, components)
    return _projected(scaled, loadings, keep)


def pca_variance(df: DataFrame, columns, components: int = COMPONENTS) -> DataFrame:
    """(component, ratio, total): share of variance by component and up to it."""
    _, _, shares = fit_pca(df, columns, components)
    rows = [(i + 1, s, float(sum(shares[: i + 1]))) for i, s in enumerate(shares)]
    return df.sparkSession.createDataFrame(rows, "component int, ratio double, total double")


def pca_loadings(df: DataFrame, columns, limit: int = TOP_LOADINGS, summed: bool = False) -> DataFrame:
    """Absolute loadings of the first two components, largest first."""
    columns = list(columns)
    _, loadings, _ = fit_pca(df, columns, PROFILE_COMPONENTS)
    a = np.abs(loadings)
    second = a[:, 1] if a.shape[1] > 1 else np.zeros(len(columns))
    rows = [(c, float(x), float(y), float(x + y)) for c, x, y in zip(columns, a[:, 0], second)]
    order = 3 if summed else 1
    rows.sort(key=lambda r: (-r[order], r[0]))
    return df.sparkSession.createDataFrame(
        rows[:limit], "feature string, pc1_loading double, pc2_loading double, importance double"
    )


def fixed_kmeans_profile(df: DataFrame, columns, keep=("hash", "author"), restarts: int = RESTARTS) -> dict[str, DataFrame]:
    """Five clusters of the mean-filled, standardised columns, seen in two components."""
    columns, session = list(columns), df.sparkSession
    with reused(ft.impute_mean(df.select(*keep, *columns), columns)) as filled:
        scaled, loadings, _ = fit_pca(filled, columns, PROFILE_COMPONENTS)
        with reused(scaled.select(vector_to_array("features").alias("x"))) as rows:
            fits = lloyd.fit_all(rows, [PROFILE_CLUSTERS], restarts, SEED)
        centers_ = fits[PROFILE_CLUSTERS][0] if fits else np.zeros((0, len(columns)))
        points = _projected(_labelled(scaled, centers_), loadings, [*keep, "cluster"])
        importances = pca_loadings(filled, columns, summed=True)
    centers = [(i, *map(float, c @ loadings)) for i, c in enumerate(centers_)]
    names = ", ".join(f"pc{j + 1} double" for j in range(loadings.shape[1]))
    return {
        "points": points,
        "centers": session.createDataFrame(centers, f"cluster int, {names}"),
        "sizes": cluster_sizes(points),
        "loadings": importances,
    }
