"""Reports made of several operators. Each returns {name: DataFrame}; a step left out is absent."""

from pyspark.sql import DataFrame, functions as F

from commitlore.operators import (
    activity, baskets, clusters, features, filters, impact, metrics, models, neighbours, network, profile, quality, similarity,
)
from commitlore.operators.communities import graph_communities
from commitlore.operators.mentions import COMMAS, known_changes
from commitlore.schema import DMM_COLUMNS
from commitlore.session import stage

# Graphs of similar commits.
NEIGHBOURS, THRESHOLD = "neighbours", "threshold"


def quality_report(commits: DataFrame, higher_is_better: bool = False) -> dict[str, DataFrame]:
    """All quality statistics. The table is cut to what they need and written once."""
    needed = [c for c in ("author_date", *DMM_COLUMNS) if c in commits.columns]
    if not set(DMM_COLUMNS) & set(needed):
        return {}
    table = stage(commits.select(*needed))
    report = {
        "dmm_metrics": quality.dmm_metrics(table),
        "composite_dmm_score": quality.composite_dmm_score(table),
        "quality_distribution": quality.quality_distribution(table),
        "quality_classes": quality.quality_classes(table, higher_is_better=higher_is_better),
        "quality_score": quality.quality_score(table, higher_is_better=higher_is_better),
        "quality_score_bands": quality.quality_score_bands(table, higher_is_better=higher_is_better),
    }
    if {"author_date", "dmm_unit_complexity"} <= set(needed):
        report["yearly_quality"] = quality.yearly_quality(table)
    return report


def tidy(report: dict[str, DataFrame]) -> DataFrame:
    """(section, item, metric, value): the numbers of several tables below each other.

    Text, date and key columns of a row make up its item.
    """
    from pyspark.sql import types as T

    parts = []
    for section, df in report.items():
        numbers = [
            f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in ("percentile", "year", "hour", "bin", "rank")
        ]
        names = [f.name for f in df.schema.fields if f.name not in numbers]
        item = F.concat_ws("/", *[F.col(n).cast("string") for n in names]) if names else F.lit("all")
        pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in numbers]
        parts.append(
            df.select(F.lit(section).alias("section"), item.alias("item"), F.explode(F.array(*pairs)).alias("p"))
            .select("section", "item", "p.*")
        )
    return metrics.union_all(parts)


def file_modification_report(file_changes: DataFrame, commits: DataFrame | None = None, column: str = "filename") -> dict[str, DataFrame]:
    files = file_changes.select("hash", "pos", F.col(column).alias("file"))
    kinds = baskets.leading_kinds(files)  # for both kinds of pairs
    report = {
        "most_modified_files": activity.most_modified_files(file_changes, column),
        "extension_distribution": activity.extension_distribution(file_changes, column),
        "files_per_commit": activity.files_per_commit_histogram(file_changes),
        "top_pairs": baskets.top_pairs_of(kinds),
        "co_change_network": network.network_of_pairs(baskets.top_pairs_of(kinds, ordered=False)),
        "directory_activity": activity.directory_activity(file_changes),
    }
    if commits is not None and "committer_date" in commits.columns:
        report["hourly_activity"] = activity.hourly_activity(commits)
    return report


def activity_report(commits: DataFrame, file_changes: DataFrame | None = None, profile_clusters: bool = True) -> dict[str, DataFrame]:
    """The tables behind the charts; each only where its columns are there."""
    has = set(commits.columns)
    report = {}
    if "author" in has:
        report["top_authors"] = activity.top_authors(commits)
    if "committer_date" in has:
        report["monthly_commits"] = activity.monthly_commits(commits)
    for c in ("main_file_type", "main_change_type"):
        if c in has:
            report[c] = activity.value_counts(commits, c)
    if {"insertions", "deletions", "files"} <= has:
        report["churn_scatter"] = activity.churn_scatter(commits)
        report["files_histogram"] = activity.equal_width_histogram(commits, "files")
        report["commit_size_classes"] = activity.commit_size_classes(commits)
        if {"committer_date", "project_name"} <= has:
            report["daily_churn"] = activity.daily_churn(commits)
    if set(DMM_COLUMNS) <= has:
        report["correlation_matrix"] = features.correlation_matrix(commits)
    if profile_clusters:
        columns = filters.exclude_id_like(filters.numeric_columns(commits))
        if len(columns) >= 2:
            keep = [c for c in ("hash", "author") if c in has]
            report.update({f"profile_{k}": v for k, v in clusters.fixed_kmeans_profile(commits, columns, keep).items()})
    changes = known_changes(commits, file_changes, COMMAS)
    if changes is not None:
        report.update(file_modification_report(changes, commits, "filename" if file_changes is not None else "path"))
    return report


def mine_associations(file_changes: DataFrame, max_files: int | None = baskets.MAX_FILES, column: str = "path") -> dict[str, DataFrame]:
    """Frequent sets, rules and their statistics."""
    members = stage(baskets.file_memberships(file_changes, max_files=max_files, column=column))
    itemsets = baskets.frequent_itemsets(members)
    rules = stage(baskets.top_rules(baskets.association_rules(itemsets)))
    return {
        "frequent_itemsets": itemsets,
        "association_rules": rules,
        "rule_statistics": baskets.rule_statistics(rules),
        "strong_associations": baskets.strong_rules(rules),
        "itemset_statistics": baskets.itemset_statistics(itemsets),
        "itemset_sizes": baskets.itemset_sizes(itemsets),
        "totals": baskets.basket_totals(members),
        "most_modified_files": baskets.file_frequencies(members, 10),
        "cooccurrences": baskets.cooccurrence_with_top(members.groupBy("hash").agg(F.sort_array(F.collect_list("file")).alias("files"))),
        **{f"network_{k}": v for k, v in network.association_network(rules).items()},
    }


def cluster_analysis(
    feature_rows: DataFrame, key: str = "hash", max_clusters: int = clusters.MAX_CLUSTERS,
    restarts: int = clusters.RESTARTS, communities: bool = True, graph: str = NEIGHBOURS,
) -> dict[str, DataFrame]:
    """Components, k-means over k, communities of similar commits, and an evaluation of both.

    Communities are those of the graph of nearest neighbours, whose size grows with the rows. With graph="threshold" they are
    those of the tenth of all pairs that are most similar; this compares all pairs and keeps a tenth of them.
    """
    chosen = stage(clusters.clustering_features(feature_rows, keep=(key,)))
    columns = [c for c in chosen.columns if c != key]
    if len(columns) < 2:
        return {}
    vectors = stage(clusters.assembled(chosen, columns).select(key, "features"))
    report = {
        "pca_coordinates": clusters.pca_projection(chosen, columns, keep=(key,)),
        "pca_variance": clusters.pca_variance(chosen, columns),
        "pca_loadings": clusters.pca_loadings(chosen, columns),
    }
    labelled = {}
    sweep = clusters.kmeans_sweep(vectors, max_clusters, restarts)
    if "labels" in sweep:
        report.update({f"kmeans_{k}": sweep[k] for k in ("scores", "centers", "sizes", "labels")})
        labelled["kmeans"] = sweep["labels"]
    if communities:
        from pyspark.ml.functions import vector_to_array

        rows = vectors.select(key, vector_to_array("features").alias("vec"), "features")
        nodes = stage(similarity.vector_nodes(rows, key, "vec"))
        if graph == THRESHOLD:
            edges = neighbours.weighted(similarity.similarity_graph(nodes, *similarity.similarity_scale(nodes)), nodes)
        else:
            edges = neighbours.neighbour_graph(nodes)
        found = graph_communities(edges)
        # a node without edges is a community of its own
        by_vector = nodes.join(found, "node", "left").select("vec", F.coalesce("community", F.col("node")).alias("name"))
        codes = by_vector.select("name").distinct()
        numbered, _ = features.label_dictionaries(codes, ["name"])["name"]
        placed = by_vector.join(numbered, F.col("name") == F.col("value")).select("vec", F.col("code").alias("cluster"))
        members = stage(rows.join(placed, "vec").drop("vec"))
        report["communities"] = members.select(key, "cluster")
        report["community_sizes"] = clusters.cluster_sizes(members)
        labelled["communities"] = members
    if labelled:
        report["evaluation"] = clusters.cluster_report(labelled)
    return report


def predict_all(feature_rows: DataFrame, **options) -> dict[str, dict[str, DataFrame]]:
    """Hold-out models of the metrics, their quality class, the file type and the change type."""
    has = set(feature_rows.columns)
    out = {"dmm_regression": models.train_regressors(feature_rows, **options)}
    if "dmm_unit_complexity" in has:
        out["dmm_classification"] = models.predict_quality_class(feature_rows, **options)
    if "main_file_type" in has:
        out["file_type"] = models.predict_file_type(feature_rows, **options)
    if "main_change_type" in has:
        out["change_type"] = models.predict_change_type(feature_rows, **options)
    return out


def risk_report(commits: DataFrame, feature_rows: DataFrame | None = None, **options) -> dict:
    """Cross-validated models of the DMM score and the risk level."""
    missing = [c for c in DMM_COLUMNS if c not in commits.columns]
    if missing:
        return {"error": f"no columns {', '.join(missing)}"}
    report = {"dmm_data_summary": quality.dmm_data_summary(commits)}
    table = feature_rows if feature_rows is not None else stage(features.feature_table(commits, keep_hash=True))
    scored = features.dmm_score(table)
    reason = filters.min_rows_guard(scored.filter("dmm_score is not null"))
    if reason:
        return {**report, "error": reason}
    levels = features.quartile_label(scored, "dmm_score", "dmm_risk_level")
    return {
        **report,
        "regression": models.cv_regression(scored, **options),
        "classification": models.cv_classification(levels, **options),
        "levels": levels.groupBy("dmm_risk_level").agg(F.count("*").alias("commits")),
    }


def model_scoreboard(models_by_task: dict) -> DataFrame | None:
    """All model scores as (task, model, metric, value)."""
    frames = [m["scores"] for m in models_by_task.values() if m.get("scores") is not None]
    return metrics.union_all([metrics.model_scoreboard(f) for f in frames]) if frames else None


def analyze_commits(
    commits: DataFrame, file_changes: DataFrame | None = None, with_quality: bool = True, with_rules: bool = True,
    with_clusters: bool = True, with_models: bool = True, embed_messages: bool = True,
    cluster_options: dict | None = None, model_options: dict | None = None,
) -> dict:
    """Quality on raw and on scaled values, rules, clusters and models of one commit table.

    Without file changes, rules are mined from the files that the commits' rows list themselves.
    """
    raw = stage(commits)
    scaled = stage(features.feature_table(raw, embed_messages=embed_messages, keep_hash=True))
    report = {"profile": profile.profile_table(raw)}
    if with_quality:
        report["quality_raw"] = quality_report(raw)
        report["quality_scaled"] = quality_report(scaled)
    changes = known_changes(raw, file_changes)
    if with_rules and changes is not None:
        report["associations"] = mine_associations(changes)
    if with_clusters:
        report["clusters"] = cluster_analysis(scaled, **(cluster_options or {}))
    if with_models:
        report["models"] = predict_all(scaled, **(model_options or {}))
        report["scoreboard"] = model_scoreboard(report["models"])
    return report


def analyze_repository(
    commits: DataFrame, file_changes: DataFrame | None = None, with_risk: bool = True, target_file: str | None = None,
    model_options: dict | None = None, **steps,
) -> dict:
    """Basic statistics, the analyses above, risk models and, for a file, its impact."""
    report = {
        "basic_statistics": activity.basic_statistics(commits),
        "file_types": activity.value_counts(commits, "main_file_type"),
        "change_types": activity.value_counts(commits, "main_change_type"),
        **analyze_commits(commits, file_changes, model_options=model_options, **steps),
    }
    options = model_options or {}
    file_changes = known_changes(commits, file_changes)
    if with_risk:
        report["risk"] = risk_report(commits, **options)
    if target_file and file_changes is not None and "associations" in report:
        rules = impact.printed_rules(report["associations"]["association_rules"])
        table = stage(features.feature_table(commits, keep_hash=True))
        found = impact.file_impact(table, file_changes, rules, target_file, **options)
        report["impact"] = found
        if found["scores"] is not None:
            report["impact_summary"] = impact.file_impact_summary(found["scores"], found["importances"])
    return report
