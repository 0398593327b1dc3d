"""Activity counts, per-commit roll-ups and profiles."""

from pyspark.sql import functions as F

from commitlore.operators import activity, commit_rollups, profile
from commitlore.registry.base import COMMITS, COMMITS_WITH_ROLLUPS, FILE_CHANGES, ROLLUPS, query, rounded
from commitlore.schema import DMM_COLUMNS
from commitlore.sources.sample_views import commits, file_changes, table


@query("main_file_type", f"WITH {FILE_CHANGES},{ROLLUPS} SELECT * FROM main_types")
def main_file_type(spark, sf_dir):
    return commit_rollups.main_file_type(file_changes(spark, sf_dir))


@query("main_file_type_counting_bare_names", f"""WITH {FILE_CHANGES},{ROLLUPS}
SELECT hash, ext AS main_file_type FROM (
  SELECT *, row_number() OVER (PARTITION BY hash ORDER BY n DESC, first) AS r FROM extensions) WHERE r = 1""")
def main_file_type_counting_bare_names(spark, sf_dir):
    return commit_rollups.main_file_type(file_changes(spark, sf_dir), count_without_extension=True)


@query("main_change_type", f"WITH {FILE_CHANGES},{ROLLUPS} SELECT * FROM main_changes")
def main_change_type(spark, sf_dir):
    return commit_rollups.main_change_type(file_changes(spark, sf_dir))


@query("commit_table", f"""WITH {COMMITS_WITH_ROLLUPS}
SELECT hash, author, author_date, committer_date, insertions, deletions, files, dmm_unit_size, main_file_type, main_change_type
FROM full_commits""")
def commit_table(spark, sf_dir):
    return commits(
        spark, sf_dir, "hash", "author", "author_date", "committer_date", "insertions", "deletions",
        "files", "dmm_unit_size", "main_file_type", "main_change_type",
    )


@query("basic_statistics", f"""WITH {COMMITS}
SELECT count(*) AS total_commits, count(DISTINCT author) AS unique_authors, min(author_date) AS first_date,
       max(author_date) AS last_date, cast(sum(files) AS bigint) AS total_files_changed,
       cast(sum(insertions) AS bigint) AS total_lines_added, cast(sum(deletions) AS bigint) AS total_lines_deleted,
       round(avg(files), 6) AS avg_files_per_commit, round(avg(lines), 6) AS avg_lines_per_commit FROM commits""")
def basic_statistics(spark, sf_dir):
    df = commits(spark, sf_dir, "author", "author_date", "files", "insertions", "deletions", "lines")
    return rounded(activity.basic_statistics(df), "avg_files_per_commit", "avg_lines_per_commit")


@query("value_counts_file_type", f"""WITH {COMMITS_WITH_ROLLUPS}
SELECT main_file_type, count(*) AS commits FROM full_commits WHERE main_file_type IS NOT NULL GROUP BY 1""")
def value_counts_file_type(spark, sf_dir):
    return activity.value_counts(commits(spark, sf_dir, "main_file_type"), "main_file_type")


@query("value_counts_change_type", f"""WITH {COMMITS_WITH_ROLLUPS}
SELECT main_change_type, count(*) AS commits FROM full_commits WHERE main_change_type IS NOT NULL GROUP BY 1""")
def value_counts_change_type(spark, sf_dir):
    return activity.value_counts(commits(spark, sf_dir, "main_change_type"), "main_change_type")


@query("top_file_types", f"""WITH {COMMITS_WITH_ROLLUPS}
SELECT main_file_type, count(*) AS commits FROM full_commits WHERE main_file_type IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_file_types(spark, sf_dir):
    return activity.value_counts(commits(spark, sf_dir, "main_file_type"), "main_file_type", 10)


@query("top_authors", f"""WITH {COMMITS}
SELECT author, count(*) AS commits FROM commits GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def top_authors(spark, sf_dir):
    return activity.top_authors(commits(spark, sf_dir, "author"))


@query("monthly_commits", f"""WITH {COMMITS}
SELECT strftime(committer_date, '%Y-%m') AS month, count(*) AS commits FROM commits GROUP BY 1""")
def monthly_commits(spark, sf_dir):
    return activity.monthly_commits(commits(spark, sf_dir, "committer_date"))


@query("hourly_activity", f"""WITH {COMMITS}
SELECT cast(hour(committer_date) AS int) AS hour, count(*) AS commits FROM commits GROUP BY 1""")
def hourly_activity(spark, sf_dir):
    return activity.hourly_activity(commits(spark, sf_dir, "committer_date"))


@query("hourly_events", "SELECT cast(hour(ts) AS int) AS hour, count(*) AS commits FROM events GROUP BY 1")
def hourly_events(spark, sf_dir):
    return activity.hourly_activity(table(spark, sf_dir, "events"), "ts")


@query("most_modified_files", f"""WITH {FILE_CHANGES}
SELECT filename AS file, count(*) AS mentions FROM file_changes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def most_modified_files(spark, sf_dir):
    return activity.most_modified_files(file_changes(spark, sf_dir))


@query("extension_distribution", f"""WITH {FILE_CHANGES}
SELECT CASE WHEN contains(filename, '.') THEN split_part(filename, '.', -1) ELSE 'no_ext' END AS extension,
       count(*) AS mentions FROM file_changes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def extension_distribution(spark, sf_dir):
    return activity.extension_distribution(file_changes(spark, sf_dir))


@query("directory_activity", f"""WITH {FILE_CHANGES}
SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, count(*) AS mentions
FROM file_changes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def directory_activity(spark, sf_dir):
    return activity.directory_activity(file_changes(spark, sf_dir))


_HISTOGRAM = """
b AS (SELECT cast(min(n) AS double) AS lo, (max(n) - min(n)) / 30.0e0 AS w FROM x)
SELECT bin, round(lo + bin * w, 6) AS bin_start, count(*) AS commits FROM (
  SELECT cast(least(floor((n - lo) / w), 29) AS int) AS bin, lo, w FROM x, b) GROUP BY bin, lo, w"""


@query("files_per_commit_histogram", f"WITH {FILE_CHANGES}, x AS (SELECT count(*) AS n FROM file_changes GROUP BY hash),{_HISTOGRAM}")
def files_per_commit_histogram(spark, sf_dir):
    return rounded(activity.files_per_commit_histogram(file_changes(spark, sf_dir)), "bin_start")


@query("files_column_histogram", f"WITH {COMMITS}, x AS (SELECT files AS n FROM commits),{_HISTOGRAM}")
def files_column_histogram(spark, sf_dir):
    return rounded(activity.equal_width_histogram(commits(spark, sf_dir, "files"), "files"), "bin_start")


@query("commit_size_classes", f"""WITH {COMMITS}
SELECT CASE WHEN s <= 10 THEN 'small' WHEN s <= 50 THEN 'medium' WHEN s <= 200 THEN 'large' ELSE 'huge' END AS size_class,
       count(*) AS commits FROM (SELECT insertions + deletions AS s FROM commits) WHERE s > 0 GROUP BY 1""")
def commit_size_classes(spark, sf_dir):
    return activity.commit_size_classes(commits(spark, sf_dir, "insertions", "deletions"))


@query("churn_points", f"WITH {COMMITS} SELECT hash, insertions, deletions FROM commits")
def churn_points(spark, sf_dir):
    return activity.churn_points(commits(spark, sf_dir, "hash", "insertions", "deletions"))


@query("churn_scatter", f"""WITH {COMMITS},
b AS (SELECT min(insertions) AS i0, (max(insertions) - min(insertions)) / 50.0e0 AS iw,
             min(deletions) AS d0, (max(deletions) - min(deletions)) / 50.0e0 AS dw FROM commits)
SELECT cast(least(floor((insertions - i0) / iw), 49) AS int) AS insertions_bin,
       cast(least(floor((deletions - d0) / dw), 49) AS int) AS deletions_bin, count(*) AS commits FROM commits, b GROUP BY 1, 2""")
def churn_scatter(spark, sf_dir):
    return activity.churn_scatter(commits(spark, sf_dir, "insertions", "deletions"))


@query("daily_churn", f"""WITH {COMMITS},
d AS (SELECT project_name, cast(committer_date AS date) AS day, sum(insertions) AS i, sum(deletions) AS d FROM commits GROUP BY 1, 2)
SELECT project_name, day, cast(sum(i) OVER w AS bigint) AS cumulative_insertions,
       cast(sum(d) OVER w AS bigint) AS cumulative_deletions
FROM d WINDOW w AS (PARTITION BY project_name ORDER BY day)""")
def daily_churn(spark, sf_dir):
    return activity.daily_churn(commits(spark, sf_dir, "project_name", "committer_date", "insertions", "deletions"))


@query("cumulative_churn", f"""WITH {COMMITS}
SELECT project_name, hash, committer_date, cast(sum(insertions) OVER w AS bigint) AS cumulative_insertions,
       cast(sum(deletions) OVER w AS bigint) AS cumulative_deletions
FROM commits WINDOW w AS (PARTITION BY project_name ORDER BY committer_date, hash ROWS UNBOUNDED PRECEDING)""")
def cumulative_churn(spark, sf_dir):
    df = commits(spark, sf_dir, "project_name", "hash", "committer_date", "insertions", "deletions")
    return activity.cumulative_churn(df)


@query("profile_table", f"""WITH {COMMITS}
SELECT unnest(['rows', 'columns', 'valid_dmm_unit_size', 'valid_dmm_unit_complexity', 'valid_dmm_unit_interfacing']) AS item,
       unnest([count(*), 4, count(dmm_unit_size), count(dmm_unit_complexity), count(dmm_unit_interfacing)]) AS value FROM commits""")
def profile_table(spark, sf_dir):
    return profile.profile_table(commits(spark, sf_dir, "hash", *DMM_COLUMNS))


@query("profile_by_project", f"""WITH {COMMITS}
SELECT coalesce(project_name, 'ALL') AS project_name, count(*) AS commits FROM commits GROUP BY ROLLUP (project_name)""")
def profile_by_project(spark, sf_dir):
    return profile.profile_by_project(commits(spark, sf_dir, "project_name"))
