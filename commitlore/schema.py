"""Column layout of a commit table."""

from pyspark.sql import types as T

# The 24 columns of a commit export, in file order.
COMMIT_COLUMNS = [
    "hash", "msg", "author", "committer", "author_date", "author_timezone",
    "committer_date", "committer_zone", "branches", "in_main_branch", "merge",
    "modified_files", "parents", "project_name", "project_path", "deletions",
    "insertions", "lines", "files", "dmm_unit_size", "dmm_unit_complexity",
    "dmm_unit_interfacing", "main_file_type", "main_change_type",
]

# Column groups used by the analyses.
DMM_COLUMNS = ["dmm_unit_size", "dmm_unit_complexity", "dmm_unit_interfacing"]
SIZE_COLUMNS = ["deletions", "insertions", "lines", "files"]
CATEGORY_COLUMNS = ["author", "committer", "branches", "main_file_type", "main_change_type"]
FLAG_COLUMNS = ["in_main_branch", "merge"]
DATE_COLUMNS = ["author_date", "committer_date"]
IDENTIFIER_COLUMNS = [
    "hash", "msg", "author_date", "author_timezone", "committer_date",
    "committer_zone", "project_path", "parents", "project_name",
]
CHANGE_TYPES = ["ADD", "DELETE", "MODIFY", "RENAME"]

# A CSV export read as text; typed_commits() in sources.commits gives it its types.
RAW_COMMIT_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in COMMIT_COLUMNS]
)

FILE_CHANGE_SCHEMA = T.StructType([
    T.StructField("hash", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("change_type", T.StringType()),
])

REPO_CONFIG_SCHEMA = T.StructType([
    T.StructField("repo_url", T.StringType()),
    T.StructField("since", T.StringType()),
    T.StructField("to", T.StringType()),
    T.StructField("only_in_branch", T.StringType()),
    T.StructField("only_modifications_with_file_types", T.ArrayType(T.StringType())),
    T.StructField("skip_empty_dmm", T.BooleanType()),
])
