"""Named queries over the sample tables, each with SQL to check it by."""

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)` under `name`, with equivalent SQL where there is one."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# The two views in SQL.
FILE_CHANGES = """
file_changes AS (
  SELECT cast(l_orderkey AS varchar) AS hash,
         cast(l_linenumber AS bigint) * 1000000000000 + l_partkey AS pos,
         dir || '/' || filename AS path, filename,
         CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN 'RENAME'
              WHEN l_returnflag = 'A' THEN 'ADD' WHEN l_returnflag = 'R' THEN 'DELETE'
              ELSE 'MODIFY' END AS change_type,
         cast(l_quantity AS bigint) AS n_lines
  FROM lineitem JOIN (
    SELECT p_partkey, lower(p_type) || '/' || replace(p_name, ' ', '_') AS dir,
           CASE WHEN b = 25 THEN '.brand_25'
                ELSE 'brand_' || b || CASE b % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.md' ELSE '' END
           END AS filename
    FROM (SELECT *, cast(regexp_extract(p_brand, '([0-9]+)', 1) AS int) AS b FROM part)
  ) ON l_partkey = p_partkey
)"""

ROLLUPS = """
extensions AS (
  SELECT hash, regexp_extract(filename, '^\\.*[^.].*?(\\.[^.]*)$', 1) AS ext, count(*) AS n, min(pos) AS first
  FROM file_changes GROUP BY 1, 2
),
main_types AS (
  SELECT hash, ext AS main_file_type FROM (
    SELECT *, row_number() OVER (PARTITION BY hash ORDER BY n DESC, first) AS r FROM extensions WHERE ext <> '')
  WHERE r = 1
),
change_counts AS (
  SELECT hash, change_type, count(*) AS n,
         CASE change_type WHEN 'ADD' THEN 1 WHEN 'DELETE' THEN 2 WHEN 'MODIFY' THEN 3 ELSE 4 END AS rank
  FROM file_changes GROUP BY ALL
),
main_changes AS (
  SELECT hash, change_type AS main_change_type FROM (
    SELECT *, row_number() OVER (PARTITION BY hash ORDER BY n DESC, rank) AS r FROM change_counts)
  WHERE r = 1
)"""

COMMITS = """
line_sums AS (
  SELECT l_orderkey,
         coalesce(sum(cast(l_quantity AS bigint)) FILTER (l_returnflag <> 'R' OR (l_linestatus = 'O' AND l_linenumber = 7)), 0) AS insertions,
         coalesce(sum(cast(l_quantity AS bigint)) FILTER (l_returnflag = 'R' AND NOT (l_linestatus = 'O' AND l_linenumber = 7)), 0) AS deletions,
         sum(cast(l_quantity AS bigint)) AS lines, count(*) AS files,
         round(avg(l_discount) * 10, 6) AS dmm_unit_size,
         round(avg(l_tax) * 12.5, 6) AS dmm_unit_complexity,
         round(avg(l_quantity) / 50, 6) AS dmm_unit_interfacing
  FROM lineitem GROUP BY 1
),
commits AS (
  SELECT cast(o_orderkey AS varchar) AS hash,
         CASE WHEN o_orderkey % 50 <> 0 THEN lower(o_orderpriority) || ' ' || c_mktsegment || ' ' || o_orderstatus END AS msg,
         c_name AS author, 'c' || (o_custkey % 100) AS committer,
         o_orderdate AS author_date, o_orderdate + to_hours(o_orderkey % 24) AS committer_date,
         c_mktsegment AS branches, o_orderstatus <> 'P' AS in_main_branch, o_orderkey % 11 = 0 AS merge,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '2'
              WHEN o_orderkey % 11 = 0 THEN '[''p1'', ''p2'']' ELSE '[''p1'']' END AS parents,
         n_name AS project_name,
         cast(coalesce(insertions, 0) AS bigint) AS insertions, cast(coalesce(deletions, 0) AS bigint) AS deletions,
         cast(coalesce(lines, 0) AS bigint) AS lines, cast(coalesce(files, 0) AS bigint) AS files,
         dmm_unit_size, dmm_unit_complexity, dmm_unit_interfacing, o_orderkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN line_sums ON l_orderkey = o_orderkey
)"""

COMMITS_WITH_ROLLUPS = f"""{FILE_CHANGES},{ROLLUPS},{COMMITS},
full_commits AS (
  SELECT * FROM commits LEFT JOIN main_types USING (hash) LEFT JOIN main_changes USING (hash)
)"""

DMM_LONG = f"""{COMMITS},
dmm AS (
  SELECT hash, 'dmm_unit_size' AS metric, dmm_unit_size AS value FROM commits
  UNION ALL SELECT hash, 'dmm_unit_complexity', dmm_unit_complexity FROM commits
  UNION ALL SELECT hash, 'dmm_unit_interfacing', dmm_unit_interfacing FROM commits
)"""


def rounded(df, *columns, digits: int = 6):
    """Round doubles for comparison; adding 0.0 turns -0.0 into 0.0."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})
