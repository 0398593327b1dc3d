"""Filters and schema-level selection."""

from pyspark.sql import functions as F

from commitlore.operators import filters
from commitlore.registry.base import COMMITS, FILE_CHANGES, query
from commitlore.schema import DMM_COLUMNS, SIZE_COLUMNS
from commitlore.sources.sample_views import commits, file_changes, table


@query("drop_empty_dmm", f"WITH {COMMITS} SELECT hash, dmm_unit_size FROM commits WHERE dmm_unit_size IS NOT NULL")
def drop_empty_dmm(spark, sf_dir):
    return filters.drop_empty_dmm(commits(spark, sf_dir, "hash", "dmm_unit_size"))


@query("filter_commits", f"""WITH {FILE_CHANGES},{COMMITS}
SELECT hash, committer_date, branches FROM commits
WHERE committer_date >= TIMESTAMP '1996-01-01' AND committer_date <= TIMESTAMP '1997-12-31' AND branches = 'MACHINERY'
  AND hash IN (SELECT hash FROM file_changes WHERE suffix(filename, '.java') OR suffix(filename, '.md'))""")
def filter_commits(spark, sf_dir):
    return filters.filter_commits(
        commits(spark, sf_dir, "hash", "committer_date", "branches"), since="1996-01-01", to="1997-12-31",
        branch="MACHINERY", file_types=[".java", ".md"], file_changes=file_changes(spark, sf_dir),
    )


@query("filter_by_repo_config", f"""WITH {FILE_CHANGES},{COMMITS},
configs AS (
  SELECT n_name AS project_name, make_timestamp(1995 + n_nationkey % 4, 1, 1, 0, 0, 0.0) AS since,
         CASE WHEN n_nationkey % 3 <> 0 THEN TIMESTAMP '1998-06-30' END AS until,
         CASE WHEN n_nationkey % 5 = 0 THEN 'BUILDING' END AS branch, n_nationkey % 2 = 0 AS typed,
         n_nationkey % 4 <> 1 AS skip
  FROM nation WHERE n_nationkey % 7 <> 6)
SELECT hash, project_name, committer_date FROM commits JOIN configs USING (project_name)
WHERE committer_date >= since AND (until IS NULL OR committer_date <= until) AND (branch IS NULL OR branches = branch)
  AND (NOT skip OR dmm_unit_size IS NOT NULL)
  AND (NOT typed OR hash IN (SELECT hash FROM file_changes WHERE suffix(filename, '.py')))""")
def filter_by_repo_config(spark, sf_dir):
    key = F.col("n_nationkey")
    configs = table(spark, sf_dir, "nation").filter(key % 7 != 6).select(
        F.concat(F.lit("https://example.org/group/"), "n_name", F.lit(".git")).alias("repo_url"),
        F.concat((1995 + key % 4).cast("string"), F.lit("-01-01")).alias("since"),
        F.when(key % 3 != 0, "1998-06-30").otherwise("some day").alias("to"),
        F.when(key % 5 == 0, "BUILDING").alias("only_in_branch"),
        F.when(key % 2 == 0, F.array(F.lit(".py"))).alias("only_modifications_with_file_types"),
        (key % 4 != 1).alias("skip_empty_dmm"),
    )
    df = commits(spark, sf_dir, "hash", "project_name", "committer_date", "branches", "dmm_unit_size")
    kept = filters.filter_by_repo_config(df, configs, file_changes(spark, sf_dir))
    return kept.select("hash", "project_name", "committer_date")


@query("complete_cases", f"""WITH {COMMITS}
SELECT hash, msg, dmm_unit_complexity FROM commits WHERE msg IS NOT NULL AND dmm_unit_complexity IS NOT NULL""")
def complete_cases(spark, sf_dir):
    df = commits(spark, sf_dir, "hash", "msg", "dmm_unit_complexity")
    return filters.complete_cases(df, ["msg", "dmm_unit_complexity"])


@query("project_model_columns", f"""WITH {COMMITS}
SELECT author, insertions, dmm_unit_size FROM commits""")
def project_model_columns(spark, sf_dir):
    df = commits(spark, sf_dir, "hash", "msg", "author_date", "parents", "project_name", "author", "insertions", "dmm_unit_size")
    return filters.project_model_columns(df)


@query("numeric_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def numeric_columns(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select(*filters.numeric_columns(df))


@query("exclude_id_like", "SELECT event_type, props, ts, value FROM events")
def exclude_id_like(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select(*filters.exclude_id_like(df.columns))


@query("drop_constant_columns", "SELECT l_orderkey, l_quantity FROM lineitem")
def drop_constant_columns(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", F.lit(7).alias("always_seven"), F.lit(None).cast("double").alias("never_given")
    )
    return filters.drop_constant_columns(df)


@query("drop_correlated_columns", f"""WITH {COMMITS}
SELECT hash, files, insertions, dmm_unit_size,
       CASE WHEN (SELECT abs(corr(lines, insertions)) > 0.95 OR abs(corr(lines, files)) > 0.95 FROM commits) THEN NULL ELSE lines END AS lines
FROM commits""")
def drop_correlated_columns(spark, sf_dir):
    df = commits(spark, sf_dir, "hash", "files", "insertions", "dmm_unit_size", "lines").withColumn(
        "lines_again", F.col("lines") * 2 + 1
    )
    return filters.drop_correlated_columns(df)


@query("correlation_matrix", f"""WITH {COMMITS}
SELECT feature, other, round(r, 6) AS correlation FROM (
  SELECT unnest(['insertions', 'lines', 'lines', 'files', 'files', 'files']) AS feature,
         unnest(['deletions', 'deletions', 'insertions', 'deletions', 'insertions', 'lines']) AS other,
         unnest([corr(insertions, deletions), corr(lines, deletions), corr(lines, insertions),
                 corr(files, deletions), corr(files, insertions), corr(files, lines)]) AS r FROM commits)""")
def correlation_matrix(spark, sf_dir):
    from commitlore.operators.features import correlation_matrix as matrix
    from commitlore.registry.base import rounded

    return rounded(matrix(commits(spark, sf_dir, *SIZE_COLUMNS)), "correlation")


@query("class_distribution", f"""WITH {COMMITS} SELECT branches, count(*) AS "rows" FROM commits GROUP BY 1""")
def class_distribution(spark, sf_dir):
    return filters.class_distribution(commits(spark, sf_dir, "branches"), "branches")


@query("class_size_guard", f"""WITH {COMMITS},
r AS (SELECT unnest(['branches', 'hash', 'kind', 'none']) AS label, unnest([branches, hash, 'same', NULL]) AS class FROM commits),
c AS (SELECT label, class, count(*) AS n FROM r WHERE class IS NOT NULL GROUP BY 1, 2)
SELECT l AS label, CASE WHEN count(class) < 2 THEN 'only one class' WHEN min(n) < 2 THEN 'a class has fewer than 2 rows' END AS reason
FROM unnest(['branches', 'hash', 'kind', 'none']) t(l) LEFT JOIN c ON l = label GROUP BY 1""")
def class_size_guard(spark, sf_dir):
    df = commits(spark, sf_dir, "branches", "hash").withColumn("kind", F.lit("same")).withColumn("none", F.lit(None).cast("string"))
    return spark.createDataFrame([(c, filters.class_size_guard(df, c)) for c in df.columns], "label string, reason string")


@query("min_rows_guard", f"""WITH {COMMITS}, n AS (SELECT count(*) AS n FROM commits)
SELECT needed, CASE WHEN n < needed THEN 'only ' || n || ' rows, ' || needed || ' needed' END AS reason FROM n, unnest([10, 100000000]) t(needed)""")
def min_rows_guard(spark, sf_dir):
    df = commits(spark, sf_dir, "hash")
    return spark.createDataFrame([(n, filters.min_rows_guard(df, n)) for n in (10, 100_000_000)], "needed int, reason string")
