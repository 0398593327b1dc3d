"""Column expressions on hand-made edge rows."""

import datetime as dt

from pyspark.sql import functions as F

from commitlore.functions import dates, numbers, text


def values(spark, inputs, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def test_file_lists(spark):
    cells = ["['a.py', 'd/b.py']", "[]", None, "", "7", "a.py, b.py", "['x'", "['a.py', 'a.py']", '["it\'s.py"]', "['\\xe9.py']"]
    assert values(spark, cells, text.parse_file_list("v")) == [
        ["a.py", "d/b.py"], [], None, None, ["7"], ["a.py, b.py"], ["['x'"], ["a.py", "a.py"], ["it's.py"], ["é.py"],
    ]
    assert values(spark, cells, text.parse_file_list("v", split_commas=True))[5:7] == [["a.py", "b.py"], None]


def test_clean_basket(spark):
    out = values(spark, [[".hidden", "x/", " ", "d/b.py", "a"]], text.clean_basket("v"), "array<string>")
    assert out == [["b.py", "a"]]


def test_extensions(spark):
    names = ["a.tar.gz", ".gitignore", "..x", "a.", "README", "d.e/f", ".a.b"]
    assert values(spark, names, text.file_extension("v")) == [".gz", "", "", ".", "", "", ".b"]
    assert values(spark, ["a.tar.gz", "README"], text.plain_extension("v")) == ["gz", "no_ext"]


def test_directories(spark):
    assert values(spark, ["a/b/c.py", "c.py", "/c"], text.directory("v")) == ["a/b", "root", ""]


def test_shorten(spark):
    names = ["short.py", "exactly15chars_", "a_very_long_name.py", "a_very_long_name.pyproject", "a_very_long_name"]
    assert values(spark, names, text.shorten_filename("v")) == [
        "short.py", "exactly15chars_", "a_very_long_.py", "a_very_long_...", "a_very_long_...",
    ]


def test_words(spark):
    messages = ["Fix  the\tbug\n", None, "", "zwei Wörter　hier", "\x1cA\x1fb"]
    assert values(spark, messages, text.msg_word_count("v")) == [3, 0, 0, 3, 2]
    assert values(spark, messages, text.tokenize_message("v"))[4] == ["a", "b"]
    # the definition of a word is the one of str.split
    for m in messages:
        assert values(spark, [m], text.tokenize_message("v"))[0] == (m or "").lower().split()


def test_safe_numeric(spark):
    assert values(spark, [None, "abc", "inf", "-inf", "NaN", "2.5"], numbers.safe_numeric("v")) == [0, 0, 0, 0, 0, 2.5]


def test_commit_size_classes(spark):
    out = values(spark, [0, 1, 10, 11, 50, 51, 200, 201, None], numbers.commit_size_class("v"), "long")
    assert out == [None, "small", "small", "medium", "medium", "large", "large", "huge", None]


def test_parent_count(spark):
    cells = [None, "", "0", "2", "['a']", "['a', 'b']", "[]", "a,b,c"]
    assert values(spark, cells, numbers.parent_count("v")) == [0, 0, 0, 2, 1, 2, 0, 3]


def test_metric_or_null(spark):
    cells = ["nan", "N/A", "none", "inf", None, "0.12345", " 2 "]
    assert values(spark, cells, numbers.metric_or_null("v")) == [None, None, None, None, None, 0.123, 2.0]


def test_bool_to_int(spark):
    assert values(spark, [True, False, None], numbers.bool_to_int("v"), "boolean") == [1, 0, 0]


def test_histogram_bin(spark):
    out = values(spark, [0.0, 0.99, 1.0, 9.99, 10.0, None], numbers.histogram_bin("v", F.lit(0.0), F.lit(10.0), 10), "double")
    assert out == [0, 0, 1, 9, 9, None]
    assert values(spark, [3.0], numbers.histogram_bin("v", F.lit(3.0), F.lit(3.0), 10), "double") == [0]


def test_dates(spark):
    cells = ["2021-01-28 09:15:36+08:00", "bad", None]
    utc = values(spark, cells, F.date_format(dates.commit_time("v"), "yyyy-MM-dd HH:mm"))
    assert utc == ["2021-01-28 01:15", None, None]
    parts = dates.calendar_features(dates.commit_time("v"), "d")
    got = values(spark, cells, F.struct(*[c.alias(n) for n, c in parts.items()]))
    assert tuple(got[0]) == (2021, 1, 28, 1, 3) and tuple(got[2]) == (0, 0, 0, 0, 0)
    assert values(spark, ["2023-01-31", "31.1.2023", "some day", None], dates.config_date("v")) == [
        dt.datetime(2023, 1, 31), None, None, None,
    ]


def test_repo_names(spark):
    urls = ["https://example.org/a/b.git", "https://example.org/a/c", "d"]
    assert values(spark, urls, text.repo_name_from_url("v")) == ["b", "c", "d"]


def test_strip_set_repr(spark):
    assert values(spark, ["{'a.py'}", "{'a', 'b'}", "x"], text.strip_set_repr("v")) == ["a.py", "a', 'b", "x"]
