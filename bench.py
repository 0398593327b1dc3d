"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default *)
BENCH_QUERIES  comma-separated names, in place of the headline queries
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from commitlore.registry import QUERIES  # noqa: E402
from commitlore.session import local_session  # noqa: E402

HEADLINES = [
    "main_file_type", "main_change_type", "commit_table", "basic_statistics", "monthly_commits", "daily_churn",
    "cumulative_churn", "top_authors", "directory_activity", "files_per_commit_histogram", "filter_by_repo_config",
    "dmm_metrics", "composite_dmm_score", "quality_classes", "quality_score", "quality_score_bands", "yearly_quality",
    "clip_outliers_iqr", "standardize", "label_encode", "feature_table", "correlation_matrix",
    "file_baskets", "cooccurrence_with_top", "co_change_pairs", "top_pairs", "frequent_itemsets", "association_rules",
    "top_rules", "association_network_metrics", "similarity_graph", "silhouette", "silhouette_exact",
    "class_report", "confusion_matrix", "impact_labels", "ingest_new_commits", "stream_ingest_commits", "stream_activity",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINES
    spark = local_session(cpus, "bench", os.cpu_count() if cpus == "*" else cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # start the session's machinery, Python workers included, before the clock runs
    spark.range(1000).repartition(4).groupBy().count().collect()
    spark.range(8).mapInPandas(lambda batches: batches, "id long").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
