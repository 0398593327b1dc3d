"""Column expressions over whole tables."""

from pyspark.sql import functions as F

from commitlore.functions import dates, numbers, text
from commitlore.registry.base import COMMITS, FILE_CHANGES, query, rounded
from commitlore.sources.sample_views import commits, file_changes, table

_WORD = r"[^\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query("repo_name_from_url", "SELECT page_id, replace(split_part(url, '/', -1), '.git', '') AS repo FROM pages")
def repo_name_from_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.repo_name_from_url("url").alias("repo"))


_LISTED = "CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN '' WHEN p_partkey % 7 = 2 THEN '[]' WHEN p_partkey % 7 = 3 THEN p_name || ', ' || p_type"
_CELL_SQL = f"{_LISTED} WHEN p_partkey % 7 = 4 THEN '[''' || p_name" + " ELSE '[''' || p_name || ''', ''' || p_type || '/.' || p_brand || ''', ''' || p_type || '/' || p_brand || ''']' END"


def _cells(spark, sf_dir):
    key = F.col("p_partkey") % 7
    listed = F.concat(F.lit("['"), "p_name", F.lit("', '"), "p_type", F.lit("/."), "p_brand", F.lit("', '"), "p_type", F.lit("/"), "p_brand", F.lit("']"))
    cell = (
        F.when(key == 0, F.lit(None)).when(key == 1, "").when(key == 2, "[]")
        .when(key == 3, F.concat("p_name", F.lit(", "), "p_type")).when(key == 4, F.concat(F.lit("['"), "p_name")).otherwise(listed)
    )
    return table(spark, sf_dir, "part").select("p_partkey", cell.alias("cell"))


@query("parse_file_list", """SELECT p_partkey, CASE p_partkey % 7 WHEN 2 THEN '' WHEN 3 THEN p_name || ', ' || p_type
  WHEN 4 THEN '[''' || p_name WHEN 5 THEN p_name || '|' || p_type || '/.' || p_brand || '|' || p_type || '/' || p_brand
  WHEN 6 THEN p_name || '|' || p_type || '/.' || p_brand || '|' || p_type || '/' || p_brand END AS files FROM part""")
def parse_file_list(spark, sf_dir):
    files = text.parse_file_list("cell")
    return _cells(spark, sf_dir).select("p_partkey", F.when(files.isNotNull(), F.concat_ws("|", files)).alias("files"))


@query("parse_comma_list", """SELECT p_partkey, CASE p_partkey % 7 WHEN 2 THEN '' WHEN 3 THEN p_name || '|' || p_type
  WHEN 5 THEN p_name || '|' || p_type || '/.' || p_brand || '|' || p_type || '/' || p_brand
  WHEN 6 THEN p_name || '|' || p_type || '/.' || p_brand || '|' || p_type || '/' || p_brand END AS files FROM part""")
def parse_comma_list(spark, sf_dir):
    files = text.parse_file_list("cell", split_commas=True)
    return _cells(spark, sf_dir).select("p_partkey", F.when(files.isNotNull(), F.concat_ws("|", files)).alias("files"))


@query("clean_basket", """SELECT p_partkey, CASE p_partkey % 7 WHEN 2 THEN '' WHEN 3 THEN p_name || ', ' || p_type
  WHEN 4 THEN '[''' || p_name WHEN 5 THEN p_name || '|' || p_brand WHEN 6 THEN p_name || '|' || p_brand END AS files FROM part""")
def clean_basket(spark, sf_dir):
    files = text.clean_basket(text.parse_file_list("cell"))
    return _cells(spark, sf_dir).select("p_partkey", F.when(files.isNotNull(), F.concat_ws("|", files)).alias("files"))


@query("calendar_features", """SELECT event_id, cast(year(ts) AS int) AS ts_year, cast(month(ts) AS int) AS ts_month,
  cast(day(ts) AS int) AS ts_day, cast(hour(ts) AS int) AS ts_hour, cast(isodow(ts) - 1 AS int) AS ts_weekday FROM events""")
def calendar_features(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", *[c.alias(n) for n, c in dates.calendar_features("ts", "ts").items()]
    )


@query("commit_time", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL
  ELSE date_trunc('second', ts) - to_hours(8) END AS at FROM events""")
def commit_time(spark, sf_dir):
    printed = F.when(F.col("event_id") % 5 == 0, "no date").otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+08:00"))
    )
    return table(spark, sf_dir, "events").select("event_id", dates.commit_time(printed).alias("at"))


@query("safe_numeric", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE round(value, 6) END AS value FROM events""")
def safe_numeric(spark, sf_dir):
    k = F.col("event_id") % 6
    odd = F.when(k == 0, "abc").when(k == 1, "inf").when(k == 2, "NaN").when(k == 3, F.lit(None)).otherwise(F.col("value").cast("string"))
    return rounded(table(spark, sf_dir, "events").select("event_id", numbers.safe_numeric(odd).alias("value")), "value")


@query("churn_columns", f"""WITH {COMMITS}
SELECT hash, insertions - deletions AS net_lines, round(deletions / (insertions + 1), 6) AS churn_ratio,
       insertions + deletions AS commit_size FROM commits""")
def churn_columns(spark, sf_dir):
    return rounded(commits(spark, sf_dir, "hash", "insertions", "deletions").select(
        "hash", numbers.net_lines().alias("net_lines"), numbers.churn_ratio().alias("churn_ratio"),
        numbers.commit_size().alias("commit_size"),
    ), "churn_ratio")


@query("parent_count", f"""WITH {COMMITS}
SELECT hash, CASE WHEN parents IS NULL THEN 0 WHEN regexp_full_match(parents, '[0-9]+') THEN cast(parents AS int)
       ELSE cast(len(string_split(parents, ',')) AS int) END AS parent_count FROM commits""")
def parent_count(spark, sf_dir):
    return commits(spark, sf_dir, "hash", "parents").select("hash", numbers.parent_count("parents").alias("parent_count"))


@query("message_size", f"""WITH {COMMITS}
SELECT hash, cast(length(coalesce(msg, '')) AS int) AS msg_length,
       cast(len(regexp_extract_all(coalesce(msg, ''), '{_WORD}')) AS int) AS msg_word_count FROM commits""")
def message_size(spark, sf_dir):
    return commits(spark, sf_dir, "hash", "msg").select(
        "hash", text.msg_length("msg").alias("msg_length"), text.msg_word_count("msg").alias("msg_word_count")
    )


@query("document_words", f"""SELECT doc_id, cast(length(text) AS int) AS msg_length,
  cast(len(regexp_extract_all(text, '{_WORD}')) AS int) AS msg_word_count FROM documents""")
def document_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.msg_length("text").alias("msg_length"), text.msg_word_count("text").alias("msg_word_count")
    )


@query("tokenize_message", f"""SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '{_WORD}'), '|') AS tokens FROM conversations""")
def tokenize_message(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat_ws("|", text.tokenize_message("text")).alias("tokens")
    )


@query("path_parts", f"""WITH {FILE_CHANGES}
SELECT hash, pos, split_part(path, '/', -1) AS base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir,
       CASE WHEN filename = '.brand_25' THEN '' ELSE regexp_extract(filename, '(\\.[a-z]+)$', 1) END AS ext FROM file_changes""")
def path_parts(spark, sf_dir):
    return file_changes(spark, sf_dir).select(
        "hash", "pos", text.base_name("path").alias("base"), text.directory("path").alias("dir"),
        text.file_extension("path").alias("ext"),
    )


@query("shorten_filename", f"""WITH {FILE_CHANGES},
d AS (SELECT DISTINCT path, split_part(path, '.', -1) AS ext FROM file_changes)
SELECT path, CASE WHEN length(path) <= 15 THEN path
  WHEN contains(path, '.') AND length(ext) < 5 THEN substr(substr(path, 1, length(path) - length(ext) - 1), 1, 14 - length(ext)) || '.' || ext
  ELSE substr(path, 1, 12) || '...' END AS short,
  CASE WHEN length(path) > 20 THEN substr(path, 1, 20) || '...' ELSE path END AS cut FROM d""")
def shorten_filename(spark, sf_dir):
    return file_changes(spark, sf_dir).select("path").distinct().select(
        "path", text.shorten_filename("path").alias("short"), text.truncated("path", 20).alias("cut")
    )


@query("bool_to_int", f"""WITH {COMMITS} SELECT hash, cast(in_main_branch AS int) AS in_main_branch, cast(merge AS int) AS merge FROM commits""")
def bool_to_int(spark, sf_dir):
    df = commits(spark, sf_dir, "hash", "in_main_branch", "merge")
    unset = F.when(F.col("merge"), True)
    return df.select("hash", numbers.bool_to_int("in_main_branch").alias("in_main_branch"), numbers.bool_to_int(unset).alias("merge"))


@query("metric_or_null", "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 5 = 1 THEN NULL ELSE round(value, 3) END AS metric FROM events")
def metric_or_null(spark, sf_dir):
    k = F.col("event_id") % 5
    shown = F.when(k == 0, "n/a").when(k == 1, "nan").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", numbers.metric_or_null(shown).alias("metric"))


@query("strip_set_repr", "SELECT p_partkey, p_name AS file FROM part")
def strip_set_repr(spark, sf_dir):
    shown = F.concat(F.lit("{'"), "p_name", F.lit("'}"))
    return table(spark, sf_dir, "part").select("p_partkey", text.strip_set_repr(shown).alias("file"))
