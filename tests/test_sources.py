"""Reading, writing, ingest and streams."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from commitlore.operators import filters, mentions
from commitlore.schema import COMMIT_COLUMNS
from commitlore.sources import commits, configs, quoted_lines, results
from commitlore.streaming import activity, ingest

HEADER = ",".join(COMMIT_COLUMNS)


def line(hash_, msg, **more):
    cells = {"hash": hash_, "msg": msg, "author_date": "2021-01-28 09:15:36+08:00", "in_main_branch": "True", "insertions": "5", **more}
    return ",".join(cells.get(c, "") for c in COMMIT_COLUMNS)


def write(path, text, charset="utf-8"):
    path.write_bytes(text.encode(charset))
    return str(path)


def test_charsets(spark, tmp_path):
    paths = [
        write(tmp_path / "a.csv", f"{HEADER}\n{line('1', 'fix é')}\n"),
        write(tmp_path / "b.csv", f"{HEADER}\n{line('2', '修复错误')}\n", "gbk"),
        write(tmp_path / "c.csv", f"{HEADER}\n{line('3', 'caf' + chr(0xE9))}\n", "latin-1"),
    ]
    df = commits.read_commits(spark, paths)
    assert {r["hash"]: r["msg"] for r in df.collect()} == {"1": "fix é", "2": "修复错误", "3": "café"}


def test_messages_with_line_breaks_and_quotes(spark, tmp_path):
    path = write(tmp_path / "a.csv", f'{HEADER}\n{line("1", chr(34) + "two" + chr(10) + "lines, " + chr(34) * 2 + "quoted" + chr(34) * 3)}\n')
    row = commits.read_commits(spark, path).first()
    assert row["msg"] == 'two\nlines, "quoted"'
    assert row["author_date"].isoformat()[:16] in ("2021-01-28T01:15", "2021-01-28T09:15")
    assert row["in_main_branch"] is True and row["merge"] is False and row["insertions"] == 5 and row["deletions"] == 0


def test_empty_and_missing_files(spark, tmp_path):
    assert commits.read_commits(spark, write(tmp_path / "a.csv", HEADER + "\n")).count() == 0
    assert commits.read_commits(spark, str(tmp_path / "nothing.csv")).count() == 0


def test_csv_round_trip(spark, tmp_path):
    path = write(tmp_path / "a.csv", f"{HEADER}\n{line('1', 'm', parents='2', merge='True', dmm_unit_size='0.25')}\n")
    first = commits.read_commits(spark, path)
    commits.write_commits(first, str(tmp_path / "out"), "csv")
    again = commits.read_commits(spark, str(tmp_path / "out"))
    assert again.collect() == first.collect()


def test_configs(spark, tmp_path):
    listed = '[{"repo_url": "https://example.org/a.git", "since": "2023-01-01"}, {"repo_url": "b"}]'
    for name, text in [("array", listed), ("object", '{"repositories": ' + listed + "}")]:
        found = configs.read_repo_configs(spark, write(tmp_path / f"{name}.json", text))
        assert [(r["repo_url"], r["since"]) for r in found.collect()] == [("https://example.org/a.git", "2023-01-01"), ("b", None)]
    with pytest.raises(ValueError):
        configs.read_repo_configs(spark, write(tmp_path / "other.json", '{"x": 1}'))


def test_each_config_filters_its_own_repository(spark):
    df = spark.createDataFrame(
        [("1", "a", "2022-12-31 00:00:00", "{'main'}", 1.0), ("2", "a", "2023-01-01 00:00:00", "{'dev', 'main'}", 1.0),
         ("3", "a", "2023-06-01 00:00:00", "{'dev'}", 1.0), ("4", "b", "2000-01-01 00:00:00", "x", None), ("5", "c", "2023-01-01 00:00:00", "x", 1.0)],
        "hash string, project_name string, d string, branches string, dmm_unit_size double",
    ).withColumn("committer_date", F.to_timestamp("d"))
    rules = configs.configs_from_urls(spark, ["https://example.org/a.git"], since="2023-01-01", branch="main").union(
        configs.configs_from_urls(spark, ["b"], since="last week", skip_empty_dmm=False)
    )
    assert sorted(r["hash"] for r in filters.filter_by_repo_config(df, rules).collect()) == ["2", "4"]
    assert sorted(r["hash"] for r in filters.filter_by_repo_config(df, rules, max_broadcast=0).collect()) == ["2", "4"]


def test_rules_from_the_first_file_there_is(spark, tmp_path):
    path = write(tmp_path / "rules.csv", "id,source,target\n1,{'a'},{'b'}\n")
    assert configs.read_rules(spark, str(tmp_path / "no.csv"), path).collect() == [("{'a'}", "{'b'}")]
    with pytest.raises(FileNotFoundError):
        configs.read_rules(spark, str(tmp_path / "no.csv"))


def test_results(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "n int, l array<string>")
    written = results.write_results({"a": df, "b": {"c": df}, "skipped": None, "k": 3}, str(tmp_path / "out"))
    assert sorted(os.path.relpath(w, tmp_path / "out") for w in written) == ["_values", "a", "b/c"]
    results.write_results({"a": df}, str(tmp_path / "flat"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "flat/a")).first()["l"] == '["a","b"]'


def commit_rows(spark, hashes):
    return spark.createDataFrame([(h, f"m{h}") for h in hashes], "hash string, msg string")


@pytest.mark.parametrize("small", [0, 1000])
def test_new_commits(spark, small):
    new = ingest.new_commits(commit_rows(spark, "abbcd"), commit_rows(spark, "bx"), small)
    assert sorted(r["hash"] for r in new.collect()) == ["a", "c", "d"]


def test_stream_equals_batch(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for hashes in ["abc", "cde", "aef"]:
        commit_rows(spark, hashes).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("hash string, msg string").parquet(source)
        ingest.stream_ingest_commits(stream, table, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r["hash"] for r in spark.read.parquet(table).collect()) == list("abcdef")
    batch = str(tmp_path / "batch")
    assert [ingest.ingest_new_commits(commit_rows(spark, h), batch) for h in ["abc", "cde", "aef", "abc"]] == [3, 2, 1, 0]


def test_repeated_batch_writes_the_same(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    commit_rows(spark, "ab").write.parquet(source)
    stream = spark.readStream.schema("hash string, msg string").parquet(source)
    # a lost checkpoint makes batch 0 run again
    for i in range(2):
        ingest.stream_ingest_commits(stream, table, str(tmp_path / f"checkpoint{i}")).awaitTermination()
    assert spark.read.parquet(table).count() == 2


def test_late_events_update_their_window(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "counts")
    for day in ["2024-01-01 10:00:00", "2024-01-03 10:00:00", "2024-01-01 11:00:00"]:
        spark.createDataFrame([(day, "p")], "d string, project string").withColumn("at", F.to_timestamp("d")).write.mode("append").parquet(source)
        stream = spark.readStream.schema("d string, project string, at timestamp").parquet(source)
        activity.stream_activity(stream, out, str(tmp_path / "checkpoint"), "at", ["project"]).awaitTermination()
    got = {r["window_start"].day: r["commits"] for r in activity.read_activity(spark, out, ["project"]).collect()}
    assert got == {1: 2, 3: 1}


def test_file_mentions(spark):
    cells = [("a", "['src/a.py', 'b.py', 'src/a.py']"), ("b", "one, two.py"), ("c", None), ("d", ""), ("e", "['broken"), ("f", "[]"), ("g", "['x', None]")]
    df = spark.createDataFrame(cells, "hash string, modified_files string")
    got = sorted(tuple(r) for r in mentions.file_mentions(df).collect())
    assert [r for r in got if r[0] in "ab"] == [("a", 0, "src/a.py", "a.py"), ("a", 1, "b.py", "b.py"), ("a", 2, "src/a.py", "a.py"), ("b", 0, "one, two.py", "one, two.py")]
    by_commas = sorted(tuple(r) for r in mentions.file_mentions(df, mentions.COMMAS).collect())
    assert [r for r in by_commas if r[0] == "b"] == [("b", 0, "one", "one"), ("b", 1, "two.py", "two.py")]
    assert not {r[0] for r in got + by_commas} & {"c", "d", "f"}
    arrays = spark.createDataFrame([("a", ["x/y", None, "z"])], "hash string, modified_files array<string>")
    assert sorted(tuple(r) for r in mentions.file_mentions(arrays).collect()) == [("a", 0, "x/y", "y"), ("a", 2, "z", "z")]
    assert mentions.file_mentions(df.filter("false")).collect() == []
    assert mentions.known_changes(df.drop("modified_files"), None) is None and mentions.known_changes(df, df) is df


def test_repository_that_cannot_be_read_is_named(spark, tmp_path):
    missing = str(tmp_path / "none")
    left_out = []
    with pytest.warns(UserWarning, match="none"):
        assert commits.union_repositories(spark, [missing], left_out).collect() == []
    assert left_out == [missing]


def test_of_repeated_hashes_the_same_row_is_taken(spark):
    rows = [("h", f"message {i}", i) for i in range(20)]
    found = {ingest.new_commits(spark.createDataFrame(order, "hash string, msg string, n int").repartition(k), None).first() for order in (rows, rows[::-1]) for k in (1, 5)}
    assert len(found) == 1


@pytest.mark.parametrize("block", [40, 1 << 20])
@pytest.mark.parametrize("seed", range(2))
def test_records_of_split_files(spark, tmp_path, block, seed):
    """Against a plain CSV reader: blocks of a few bytes cut cells, quotes and line breaks anywhere."""
    rng = random.Random(seed)
    rows = [["".join(rng.choice(['a', ',', '"', "\n", "\r\n", "é", " "]) for _ in range(rng.randrange(9))) for _ in range(3)] for _ in range(30)]
    rows += [["x", 'inch 5" disk', "z"], ["long", "line\n" * 40, "end"]]
    rng.shuffle(rows)
    rows.insert(0, ["h1", "h2", "h3"])
    text = io.StringIO()
    for row in rows:  # a quote inside a cell without quotes is a plain character
        stray = row[1] == 'inch 5" disk'
        text.write(",".join(row) + "\n") if stray else csv.writer(text, lineterminator="\n", quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerow(row)
    (tmp_path / "a.csv").write_bytes(text.getvalue().encode())
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbfh1,h2\n1,2")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        found = quoted_lines.csv_records(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = [r for r in csv.reader(io.StringIO(text.getvalue(), newline="")) if r]
    got = [next(csv.reader(io.StringIO(r["record"], newline=""))) for r in found]
    assert sorted(got) == sorted(wanted + [["h1", "h2"], ["1", "2"]])
    assert sorted(r["record"] for r in found if r["header"]) in (["h1,h2", "h1,h2,h3"], ['"h1","h2","h3"', "h1,h2"])


def test_quote_that_is_never_closed(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'h\n"a\nb"\n"open\nc\n\nd')
    found = quoted_lines.csv_records(spark, path)
    assert sorted(r["record"] for r in found.collect()) == ['"a\nb"', '"open', "c", "d", "h"]
    assert found.filter("header").first()["record"] == "h"


def test_other_header_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="not the header"):
        commits.read_commits(spark, write(tmp_path / "a.csv", "a,b\n1,2\n")).collect()
