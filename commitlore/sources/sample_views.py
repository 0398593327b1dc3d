"""Commit and file-change views over the order tables.

An order plays a commit, its lines the files it touched. Only the joins that the
asked-for columns need are planned.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from commitlore.operators.commit_rollups import commit_rollups

_FROM_CUSTOMER = {"author", "branches", "msg", "project_name"}
_FROM_LINES = {
    "insertions", "deletions", "lines", "files",
    "dmm_unit_size", "dmm_unit_complexity", "dmm_unit_interfacing",
}
VIEW_COLUMNS = [
    "hash", "msg", "author", "committer", "author_date", "committer_date", "branches",
    "in_main_branch", "merge", "parents", "project_name", "insertions", "deletions",
    "lines", "files", "dmm_unit_size", "dmm_unit_complexity", "dmm_unit_interfacing",
    "main_file_type", "main_change_type",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _change_type() -> F.Column:
    return (
        F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7), "RENAME")
        .when(F.col("l_returnflag") == "A", "ADD")
        .when(F.col("l_returnflag") == "R", "DELETE")
        .otherwise("MODIFY")
    )


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per touched file. `pos` orders the files of a commit."""
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    extension = F.element_at(
        F.array(F.lit(".py"), F.lit(".java"), F.lit(".md"), F.lit("")), brand % 4 + 1
    )
    filename = F.when(brand == 25, F.lit(".brand_25")).otherwise(
        F.concat(F.lit("brand_"), brand.cast("string"), extension)
    )
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        filename.alias("filename"),
        F.concat(F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("dir"),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("hash"),
        (F.col("l_linenumber").cast("long") * F.lit(1_000_000_000_000) + F.col("l_partkey")).alias("pos"),
        _change_type().alias("change_type"),
        F.col("l_quantity").cast("long").alias("n_lines"),
        "l_partkey",
    )
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "hash", "pos", F.concat("dir", F.lit("/"), "filename").alias("path"),
        "filename", "change_type", "n_lines",
    )


def _line_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    deleted = _change_type() == "DELETE"
    quantity = F.col("l_quantity").cast("long")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(F.when(~deleted, quantity)).alias("insertions"),
            F.sum(F.when(deleted, quantity)).alias("deletions"),
            F.sum(quantity).alias("lines"),
            F.count("*").alias("files"),
            F.round(F.avg("l_discount") * 10, 6).alias("dmm_unit_size"),
            F.round(F.avg("l_tax") * 12.5, 6).alias("dmm_unit_complexity"),
            F.round(F.avg("l_quantity") / 50, 6).alias("dmm_unit_interfacing"),
        )
    )


def commits(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The commit view, cut to `columns` (all of them by default)."""
    wanted = list(columns) or VIEW_COLUMNS
    view = table(spark, sf_dir, "orders")
    if _FROM_CUSTOMER & set(wanted):
        people = table(spark, sf_dir, "customer").join(
            table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        view = view.join(people, F.col("o_custkey") == F.col("c_custkey"))
    if _FROM_LINES & set(wanted):
        view = view.join(
            _line_sums(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left"
        )
    key = F.col("o_orderkey")
    made = {
        "hash": key.cast("string"),
        "msg": F.when(
            key % 50 != 0,
            F.concat_ws(" ", F.lower("o_orderpriority"), F.col("c_mktsegment"), F.col("o_orderstatus")),
        ) if "msg" in wanted else None,
        "author": F.col("c_name"),
        "committer": F.concat(F.lit("c"), (F.col("o_custkey") % 100).cast("string")),
        "author_date": F.col("o_orderdate").cast("timestamp"),
        "committer_date": F.timestamp_add("HOUR", (key % 24).cast("int"), F.col("o_orderdate").cast("timestamp")),
        "branches": F.col("c_mktsegment"),
        "in_main_branch": F.col("o_orderstatus") != "P",
        "merge": key % 11 == 0,
        "parents": F.when(key % 97 == 0, F.lit(None)).when(key % 13 == 0, F.lit("2"))
        .when(key % 11 == 0, F.lit("['p1', 'p2']")).otherwise(F.lit("['p1']")),
        "project_name": F.col("n_name"),
        **{c: F.coalesce(F.col(c), F.lit(0)) for c in ("insertions", "deletions", "lines", "files")},
        **{c: F.col(c) for c in ("dmm_unit_size", "dmm_unit_complexity", "dmm_unit_interfacing")},
    }
    rollups = [c for c in ("main_file_type", "main_change_type") if c in wanted]
    plain = [c for c in wanted if c not in rollups]
    result = view.select(*[made[c].alias(c) for c in dict.fromkeys(["hash", *plain])])
    if rollups:
        result = result.join(commit_rollups(file_changes(spark, sf_dir)).select("hash", *rollups), "hash", "left")
    return result.select(*wanted)
