"""Per-commit roll-ups of file changes."""

from pyspark.sql import DataFrame, functions as F

from commitlore.functions.text import file_extension
from commitlore.schema import CHANGE_TYPES


def commit_rollups(
    file_changes: DataFrame, count_without_extension: bool = False, empty_is_add: bool = False,
) -> DataFrame:
    """(hash, main_file_type, main_change_type) in one pass over the file changes.

    The most common extension counts, the first seen on a tie; the most frequent change
    type, ties in the order of CHANGE_TYPES. A commit with very many files is reduced to
    one row per extension before its parts meet in one place.
    """
    per_extension = file_changes.groupBy("hash", file_extension("filename").alias("ext")).agg(
        F.count("*").alias("n"), F.min("pos").alias("first"),
        *[F.count_if(F.col("change_type") == t).alias(t) for t in CHANGE_TYPES],
    )
    counts = F.lit(True) if count_without_extension else F.col("ext") != ""
    rank = F.when(counts, F.struct("n", -F.col("first")))
    merged = per_extension.groupBy("hash").agg(
        F.max_by("ext", rank).alias("main_file_type"), *[F.sum(t).alias(t) for t in CHANGE_TYPES]
    )
    best = F.greatest(*CHANGE_TYPES)
    chosen = F.when((best == 0) & F.lit(not empty_is_add), F.lit(None))
    for t in CHANGE_TYPES:
        chosen = chosen.when(F.col(t) == best, t)
    return merged.select("hash", "main_file_type", chosen.alias("main_change_type"))


def main_file_type(file_changes: DataFrame, count_without_extension: bool = False) -> DataFrame:
    """Most common extension of each commit that has one."""
    typed = file_changes.withColumn("change_type", F.lit(None).cast("string"))
    found = commit_rollups(typed, count_without_extension).select("hash", "main_file_type")
    return found.filter(F.col("main_file_type").isNotNull())


def main_change_type(file_changes: DataFrame, empty_is_add: bool = False) -> DataFrame:
    """Most frequent change type of each commit."""
    nameless = file_changes.select("hash", "change_type", F.lit("").alias("filename"), F.lit(0).alias("pos"))
    return commit_rollups(nameless, empty_is_add=empty_is_add).select("hash", "main_change_type")
