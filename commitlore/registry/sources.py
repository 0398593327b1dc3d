"""Reading, writing, taking in new commits, streams, and reports."""

from pyspark.sql import functions as F

from commitlore.operators import baskets as mined, mentions
from commitlore.operators.filters import filter_by_repo_config
from commitlore.plans import reports
from commitlore.registry import activity, baskets, quality  # noqa: F401  their SQL is put together below
from commitlore.registry.base import COMMITS, COMMITS_WITH_ROLLUPS, FILE_CHANGES, SQL, query, rounded
from commitlore.schema import COMMIT_COLUMNS, DMM_COLUMNS
from commitlore.session import fresh_path
from commitlore.sources import commits as commit_files, configs, results
from commitlore.sources.sample_views import VIEW_COLUMNS, commits, file_changes, table
from commitlore.streaming import activity as stream_act, ingest

# A commit's files as an export prints them.
_LISTS = """lists AS (SELECT hash, '[''' || string_agg(path, ''', ''' ORDER BY pos) || ''']' AS modified_files FROM file_changes GROUP BY 1)"""


def _exports(spark, sf_dir):
    """The commit view with the four columns it lacks: zones, the printed list of files, and a path."""
    paths = F.transform(F.sort_array(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"])
    lists = file_changes(spark, sf_dir).groupBy("hash").agg(F.concat(F.lit("['"), F.array_join(paths, "', '"), F.lit("']")).alias("modified_files"))
    number = F.col("hash").cast("long")
    return commits(spark, sf_dir, *VIEW_COLUMNS).join(lists, "hash", "left").select(
        "*", (number % 24 * 3600 - 43200).cast("int").alias("author_timezone"), F.when(number % 5 != 0, number % 12 * 3600).cast("int").alias("committer_zone"),
        F.concat(F.lit("/repositories/"), "project_name").alias("project_path")).select(*COMMIT_COLUMNS)


_READ_BACK = f"""WITH {COMMITS_WITH_ROLLUPS},{_LISTS}
SELECT hash, msg, author, committer, author_date, (o_orderkey % 24 * 3600 - 43200)::INT AS author_timezone, committer_date,
       CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 12 * 3600)::INT END AS committer_zone, branches, in_main_branch, merge, modified_files, parents, project_name,
       '/repositories/' || project_name AS project_path, deletions, insertions, lines, files, dmm_unit_size, dmm_unit_complexity, dmm_unit_interfacing,
       main_file_type, main_change_type
FROM full_commits LEFT JOIN lists USING (hash)"""


@query("commits_by_csv", _READ_BACK)
def commits_by_csv(spark, sf_dir):
    path = fresh_path(spark, "commits-csv")
    commit_files.write_commits(_exports(spark, sf_dir), path, "csv")
    return commit_files.read_commits(spark, path).select(*COMMIT_COLUMNS)


@query("commits_by_parquet", _READ_BACK)
def commits_by_parquet(spark, sf_dir):
    path = fresh_path(spark, "commits-parquet")
    commit_files.write_commits(_exports(spark, sf_dir), path)
    return commit_files.union_repositories(spark, [path]).select(*COMMIT_COLUMNS)


_MENTIONS = """SELECT hash, row_number() OVER (PARTITION BY hash ORDER BY pos) - 1 AS pos, path, filename FROM file_changes"""


@query("file_mentions", f"WITH {FILE_CHANGES} {_MENTIONS}")
def file_mentions(spark, sf_dir):
    """From an export's lists to its files."""
    path = fresh_path(spark, "commits-csv")
    commit_files.write_commits(_exports(spark, sf_dir), path, "csv")
    return mentions.file_mentions(commit_files.read_commits(spark, path))


@query("file_mentions_by_commas", f"WITH {FILE_CHANGES} {_MENTIONS}")
def file_mentions_by_commas(spark, sf_dir):
    inside = F.regexp_replace("modified_files", r"^\['|'\]$", "")
    rows = _exports(spark, sf_dir).withColumn("modified_files", F.regexp_replace(inside, "', '", " , "))
    return mentions.file_mentions(rows, mentions.COMMAS)


@query("baskets_of_export", SQL["file_baskets"])
def baskets_of_export(spark, sf_dir):
    found = mentions.file_mentions(_exports(spark, sf_dir))
    return mined.file_baskets(found).withColumn("files", F.concat_ws("|", "files"))


@query("union_repositories", f"WITH {COMMITS} SELECT hash, project_name, author, CASE WHEN branches = 'BUILDING' THEN NULL ELSE insertions END AS insertions FROM commits")
def union_repositories(spark, sf_dir):
    df = commits(spark, sf_dir, "hash", "project_name", "author", "insertions", "branches")
    paths = [fresh_path(spark, "repository") for _ in range(3)]
    building = F.col("branches") == "BUILDING"
    commit_files.write_commits(df.filter(building).drop("insertions"), paths[0])
    commit_files.write_commits(df.filter(~building), paths[1])
    # the third path is never written, and skipped
    return commit_files.union_repositories(spark, paths).select("hash", "project_name", "author", "insertions")


@query("configs_from_urls", f"""WITH {COMMITS}
SELECT hash, project_name FROM commits WHERE committer_date >= TIMESTAMP '1997-01-01' AND dmm_unit_size IS NOT NULL
  AND project_name IN (SELECT n_name FROM nation WHERE n_regionkey = 1)""")
def configs_from_urls(spark, sf_dir):
    urls = [f"https://example.org/{r['n_name']}.git" for r in table(spark, sf_dir, "nation").filter("n_regionkey = 1").collect()]
    rules = configs.configs_from_urls(spark, urls, since="1997-01-01")
    df = commits(spark, sf_dir, "hash", "project_name", "committer_date", "branches", "dmm_unit_size")
    return filter_by_repo_config(df, rules).select("hash", "project_name")


@query("read_repo_configs", f"""WITH {COMMITS}
SELECT project_name, count(*) AS commits FROM commits WHERE committer_date <= TIMESTAMP '1997-01-01' GROUP BY 1""")
def read_repo_configs(spark, sf_dir):
    path = fresh_path(spark, "configs")
    listed = table(spark, sf_dir, "nation").select(F.struct(
        F.concat(F.lit("https://example.org/"), "n_name").alias("repo_url"), F.lit("1997-01-01").alias("to"),
        F.lit(False).alias("skip_empty_dmm"),
    ).alias("r"))
    listed.agg(F.collect_list("r").alias("repositories")).write.json(path)
    df = commits(spark, sf_dir, "hash", "project_name", "committer_date", "branches", "dmm_unit_size")
    kept = filter_by_repo_config(df, configs.read_repo_configs(spark, path))
    return kept.groupBy("project_name").agg(F.count("*").alias("commits"))


@query("read_rules", "SELECT p_name AS source, p_type AS target FROM part")
def read_rules(spark, sf_dir):
    path = fresh_path(spark, "rules")
    table(spark, sf_dir, "part").select(F.col("p_name").alias("source"), F.col("p_type").alias("target")).write.option("header", True).csv(path)
    return configs.read_rules(spark, f"{path}-missing", path)


@query("write_results", f"WITH {COMMITS} SELECT project_name, count(*) AS commits FROM commits GROUP BY 1")
def write_results(spark, sf_dir):
    counts = commits(spark, sf_dir, "project_name").groupBy("project_name").agg(F.count("*").alias("commits"))
    path = fresh_path(spark, "results")
    results.write_results({"counts": counts}, path)
    return spark.read.schema(counts.schema).json(f"{path}/counts")


@query("ingest_new_commits", f"""WITH {COMMITS} SELECT hash, author_date FROM commits WHERE author_date >= TIMESTAMP '1997-01-01'""")
def ingest_new_commits(spark, sf_dir):
    df = commits(spark, sf_dir, "hash", "author_date")
    return ingest.new_commits(df, df.filter("author_date < timestamp '1997-01-01'"))


@query("ingest_new_commits_large_batch", f"""WITH {COMMITS} SELECT hash, author_date FROM commits WHERE author_date >= TIMESTAMP '1997-01-01'""")
def ingest_new_commits_large_batch(spark, sf_dir):
    df = commits(spark, sf_dir, "hash", "author_date")
    return ingest.new_commits(df, df.filter("author_date < timestamp '1997-01-01'"), small=100)


@query("ingest_twice", f"WITH {COMMITS} SELECT hash, author_date FROM commits")
def ingest_twice(spark, sf_dir):
    path = fresh_path(spark, "table")
    df = commits(spark, sf_dir, "hash", "author_date")
    ingest.ingest_new_commits(df.filter("author_date < timestamp '1998-01-01'"), path)
    ingest.ingest_new_commits(df, path)
    return spark.read.schema(df.schema).parquet(path)


def _order_stream(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    raw = spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/orders*.parquet")
    return raw.select(F.col("o_orderkey").cast("string").alias("hash"), F.col("o_orderdate").cast("timestamp").alias("author_date"))


@query("stream_ingest_commits", "SELECT cast(o_orderkey AS varchar) AS hash, o_orderdate AS author_date FROM orders")
def stream_ingest_commits(spark, sf_dir):
    stream = _order_stream(spark, sf_dir)
    path, checkpoint = fresh_path(spark, "stream-table"), fresh_path(spark, "stream-checkpoint")
    # every commit arrives twice
    ingest.stream_ingest_commits(stream.union(_order_stream(spark, sf_dir)), path, checkpoint).awaitTermination()
    return spark.read.parquet(path).drop("batch_id")


@query("stream_ingest_recent", "SELECT cast(o_orderkey AS varchar) AS hash, o_orderdate AS author_date FROM orders")
def stream_ingest_recent(spark, sf_dir):
    both = _order_stream(spark, sf_dir).union(_order_stream(spark, sf_dir)).withColumn("arrived", F.current_timestamp())
    path, checkpoint = fresh_path(spark, "stream-table"), fresh_path(spark, "stream-checkpoint")
    ingest.stream_ingest_recent(both, path, checkpoint, "arrived").awaitTermination()
    return spark.read.parquet(path).drop("arrived")


_DAILY = "SELECT date_trunc('day', ts)::timestamp AS window_start, event_type, count(*) AS commits FROM events GROUP BY 1, 2"


@query("stream_activity", _DAILY)
def stream_activity(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path, checkpoint = fresh_path(spark, "stream-counts"), fresh_path(spark, "stream-checkpoint")
    stream_act.stream_activity(stream, path, checkpoint, "ts", ["event_type"]).awaitTermination()
    return stream_act.read_activity(spark, path, ["event_type"])


@query("windowed_activity", _DAILY)
def windowed_activity(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream_act.windowed_activity(events, "ts", ["event_type"])


# --- reports -------------------------------------------------------------------


def _section(name, keys, numbers, inner=None):
    """SQL for one part of a tidy report, from a registered query's SQL."""
    item = " || '/' || ".join(f"cast({k} AS varchar)" for k in keys) if keys else "'all'"
    values = " UNION ALL ".join(
        f"SELECT '{name}' AS section, {item} AS item, '{n}' AS metric, round(cast({n} AS double), 6) AS value FROM {name}" for n in numbers
    )
    return f"{name} AS ({inner or SQL[name]})", values


def _report_sql(parts):
    sections = [_section(*p) for p in parts]
    return "WITH " + ",\n".join(s[0] for s in sections) + "\n" + " UNION ALL ".join(s[1] for s in sections)


@query("quality_report", _report_sql([
    ("dmm_metrics", ["metric"], ["mean", "std", "min", "max", "q25", "median", "q75"]),
    ("composite_dmm_score", [], ["mean", "median", "std"]),
    ("quality_distribution", ["metric", "percentile"], ["value"]),
    ("quality_classes", ["metric", "quality_class"], ["commits"]),
    ("quality_score", [], ["mean_score", "median_score", "std_score"]),
    ("quality_score_bands", [], ["excellent", "good", "fair", "poor"]),
    ("yearly_quality", ["year"], ["mean", "commits", "median"]),
]))
def quality_report(spark, sf_dir):
    df = commits(spark, sf_dir, "hash", "author_date", *DMM_COLUMNS)
    return rounded(reports.tidy(reports.quality_report(df)), "value")


@query("file_modification_report", _report_sql([
    ("most_modified_files", ["file"], ["mentions"]),
    ("extension_distribution", ["extension"], ["mentions"]),
    ("top_pairs", ["file_a", "file_b"], ["commits"]),
    ("directory_activity", ["directory"], ["mentions"]),
    ("hourly_activity", ["hour"], ["commits"]),
]))
def file_modification_report(spark, sf_dir):
    found = reports.file_modification_report(file_changes(spark, sf_dir), commits(spark, sf_dir, "committer_date"))
    kept = ["most_modified_files", "extension_distribution", "top_pairs", "directory_activity", "hourly_activity"]
    return rounded(reports.tidy({k: found[k] for k in kept}), "value")


@query("activity_report", _report_sql([
    ("top_authors", ["author"], ["commits"]),
    ("monthly_commits", ["month"], ["commits"]),
    ("main_file_type", ["main_file_type"], ["commits"], SQL["value_counts_file_type"]),
    ("main_change_type", ["main_change_type"], ["commits"], SQL["value_counts_change_type"]),
    ("commit_size_classes", ["size_class"], ["commits"]),
    ("daily_churn", ["project_name", "day"], ["cumulative_insertions", "cumulative_deletions"]),
]))
def activity_report(spark, sf_dir):
    df = commits(
        spark, sf_dir, "author", "committer_date", "main_file_type", "main_change_type", "insertions", "deletions",
        "files", "project_name",
    )
    found = reports.activity_report(df, profile_clusters=False)
    kept = ["top_authors", "monthly_commits", "main_file_type", "main_change_type", "commit_size_classes", "daily_churn"]
    return rounded(reports.tidy({k: found[k] for k in kept}), "value")


@query("mine_associations", _report_sql([
    ("totals", [], ["total_files", "total_commits"], SQL["basket_totals"]),
    ("itemset_statistics", [], ["total_itemsets", "avg_support", "max_support"]),
    ("rule_statistics", [], ["total_rules", "avg_confidence", "avg_lift", "avg_support", "max_lift", "min_lift"]),
    ("network_metrics", [], ["nodes", "edges", "density"], SQL["association_network_metrics"]),
]))
def mine_associations(spark, sf_dir):
    found = reports.mine_associations(file_changes(spark, sf_dir))
    return rounded(reports.tidy({k: found[k] for k in ("totals", "itemset_statistics", "rule_statistics", "network_metrics")}), "value")


@query("analyze_commits")
def analyze_commits(spark, sf_dir):
    found = reports.analyze_commits(commits(spark, sf_dir, *VIEW_COLUMNS), file_changes(spark, sf_dir))
    flat = {f"{a}_{b}": t for a, part in found.items() if isinstance(part, dict) for b, t in part.items()} | {"scoreboard": found["scoreboard"]}
    kept = ["quality_raw_quality_score", "quality_scaled_quality_score", "associations_totals", "clusters_kmeans_sizes", "clusters_community_sizes",
            "clusters_evaluation", "scoreboard"]
    return rounded(reports.tidy({k: flat[k] for k in kept if flat.get(k) is not None}), "value")
