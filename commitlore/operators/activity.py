"""Activity counts and time series."""

from pyspark.sql import DataFrame, Window as W, functions as F

from commitlore.functions.numbers import commit_size, commit_size_class, histogram_bin
from commitlore.functions.text import directory, plain_extension
from commitlore.operators.running import running_totals


def basic_statistics(commits: DataFrame) -> DataFrame:
    return commits.agg(
        F.count("*").alias("total_commits"),
        F.count_distinct("author").alias("unique_authors"),
        F.min("author_date").alias("first_date"),
        F.max("author_date").alias("last_date"),
        F.sum("files").alias("total_files_changed"),
        F.sum("insertions").alias("total_lines_added"),
        F.sum("deletions").alias("total_lines_deleted"),
        F.avg("files").alias("avg_files_per_commit"),
        F.avg("lines").alias("avg_lines_per_commit"),
    )


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, missing values left out."""
    counts = (
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("commits"))
        .orderBy(F.desc("commits"), column)
    )
    return counts.limit(limit) if limit else counts


def top_authors(commits: DataFrame, limit: int = 15) -> DataFrame:
    return value_counts(commits, "author", limit)


def monthly_commits(commits: DataFrame, date_col: str = "committer_date") -> DataFrame:
    return (
        commits.filter(F.col(date_col).isNotNull())
        .groupBy(F.date_format(F.date_trunc("month", date_col), "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("commits")).orderBy("month")
    )


def hourly_activity(commits: DataFrame, date_col: str = "committer_date") -> DataFrame:
    return (
        commits.filter(F.col(date_col).isNotNull()).groupBy(F.hour(date_col).alias("hour"))
        .agg(F.count("*").alias("commits")).orderBy("hour")
    )


def _top_mentions(file_changes: DataFrame, value, name: str, limit: int) -> DataFrame:
    return (
        file_changes.groupBy(value.alias(name)).agg(F.count("*").alias("mentions"))
        .orderBy(F.desc("mentions"), name).limit(limit)
    )


def most_modified_files(file_changes: DataFrame, column: str = "filename", limit: int = 15) -> DataFrame:
    return _top_mentions(file_changes, F.col(column), "file", limit)


def extension_distribution(file_changes: DataFrame, column: str = "filename", limit: int = 10) -> DataFrame:
    return _top_mentions(file_changes, plain_extension(column), "extension", limit)


def directory_activity(file_changes: DataFrame, column: str = "path", limit: int = 10) -> DataFrame:
    return _top_mentions(file_changes, directory(column), "directory", limit)


def equal_width_histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Rows per equal-width bin between the smallest and the largest value."""
    bounds = df.agg(F.struct(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")))
    binned = df.filter(F.col(column).isNotNull()).withColumn("_b", bounds.scalar())
    low, high = F.col("_b.lo"), F.col("_b.hi")
    width = (high - low) / float(bins)
    return (
        binned.groupBy(
            histogram_bin(column, low, high, bins).alias("bin"), low.alias("_lo"), width.alias("_w")
        ).agg(F.count("*").alias("commits"))
        .select("bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"), "commits")
    )


def files_per_commit_histogram(file_changes: DataFrame, bins: int = 30) -> DataFrame:
    """Commits by number of listed files."""
    return equal_width_histogram(file_changes.groupBy("hash").agg(F.count("*").alias("n")), "n", bins)


def commit_size_classes(commits: DataFrame) -> DataFrame:
    return (
        commits.groupBy(commit_size_class(commit_size()).alias("size_class"))
        .agg(F.count("*").alias("commits")).filter("size_class is not null")
    )


def churn_points(commits: DataFrame) -> DataFrame:
    """The (insertions, deletions) point of each commit."""
    return commits.select("hash", "insertions", "deletions")


def churn_scatter(commits: DataFrame, bins: int = 50) -> DataFrame:
    """The same points as a 2-D histogram, whose size does not grow with the data."""
    bounds = commits.agg(
        F.struct(
            F.min("insertions").cast("double").alias("i0"), F.max("insertions").cast("double").alias("i1"),
            F.min("deletions").cast("double").alias("d0"), F.max("deletions").cast("double").alias("d1"),
        )
    )
    placed = commits.select("insertions", "deletions").withColumn("_b", bounds.scalar())
    return placed.groupBy(
        histogram_bin("insertions", F.col("_b.i0"), F.col("_b.i1"), bins).alias("insertions_bin"),
        histogram_bin("deletions", F.col("_b.d0"), F.col("_b.d1"), bins).alias("deletions_bin"),
    ).agg(F.count("*").alias("commits"))


def daily_churn(commits: DataFrame, date_col: str = "committer_date") -> DataFrame:
    """Running totals per project by day.

    Days are summed first, so the window sees one row per project and day.
    """
    daily = commits.filter(F.col(date_col).isNotNull()).groupBy(
        "project_name", F.to_date(date_col).alias("day")
    ).agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))
    w = W.partitionBy("project_name").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return daily.select(
        "project_name", "day",
        F.sum("insertions").over(w).alias("cumulative_insertions"),
        F.sum("deletions").over(w).alias("cumulative_deletions"),
    )


def cumulative_churn(commits: DataFrame, date_col: str = "committer_date") -> DataFrame:
    """Running totals per project at each commit, in (date, hash) order; a project, or a moment, of any size is many tasks' work."""
    dated = commits.filter(F.col(date_col).isNotNull()).select("project_name", "hash", date_col, "insertions", "deletions")
    totals = {"cumulative_insertions": "insertions", "cumulative_deletions": "deletions"}
    return running_totals(dated, ["project_name"], [date_col, "hash"], totals).drop("insertions", "deletions")
