"""Quantiles, roll-ups, quality and features against plain computations."""

import datetime as dt
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from commitlore.operators import activity, commit_rollups, embeddings, features, filters, quality, running, splits
from commitlore.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("limit", [3, 50, 10**6])
def test_quantiles_by_narrowing(spark, limit):
    rng = np.random.default_rng(1)
    columns = {
        "even": rng.random(4000),
        "tied": rng.integers(0, 5, 4000).astype(float),
        "long_tail": np.exp(rng.normal(0, 8, 4000)),
        "one_hot_value": np.where(rng.random(4000) < 0.4, 7.0, rng.random(4000) * 100),
    }
    df = spark.createDataFrame(pd.DataFrame(columns)).repartition(5)
    found = exact_quantiles(df, list(columns), PROBS, buffer_values=limit)
    for c, v in columns.items():
        assert np.allclose(found[c], np.quantile(v, PROBS), rtol=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e300, 1e300)), min_size=1, max_size=40))
def test_quantiles_of_anything(spark, numbers):
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    found = exact_quantiles(df, ["x"], [0.25, 0.5], buffer_values=2)["x"]
    given_ones = [x for x in numbers if x is not None]
    if not given_ones:
        assert found == [None, None]
    else:
        assert np.allclose(found, np.quantile(given_ones, [0.25, 0.5]), rtol=1e-9, atol=0)


def test_quantiles_skip_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double").withColumn("y", F.lit(None).cast("double"))
    assert exact_quantiles(df, ["x", "y"], [0.5]) == {"x": [2.0], "y": [None]}


def changes(spark, rows):
    return spark.createDataFrame(rows, "hash string, pos long, filename string, change_type string")


def test_rollup_ties(spark):
    df = changes(spark, [
        ("a", 0, "x.js", "MODIFY"), ("a", 1, "y.py", "ADD"), ("b", 0, "README", "DELETE"), ("b", 1, "LICENSE", "RENAME"),
        ("c", 0, "q", "COPY"), ("d", 0, "A", "ADD"), ("d", 1, "B", "ADD"), ("d", 2, "c.md", "ADD"),
    ])
    assert dict(commit_rollups.main_file_type(df).collect()) == {"a": ".js", "d": ".md"}
    assert dict(commit_rollups.main_file_type(df, True).collect()) == {"a": ".js", "b": "", "c": "", "d": ""}
    assert dict(commit_rollups.main_change_type(df).collect()) == {"a": "ADD", "b": "DELETE", "c": None, "d": "ADD"}
    assert dict(commit_rollups.main_change_type(df, True).collect())["c"] == "ADD"


def dmm(spark, rows):
    return spark.createDataFrame(rows, "dmm_unit_size double, dmm_unit_complexity double, dmm_unit_interfacing double")


def test_quality_score_by_hand(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame(rng.random((60, 3)), columns=["dmm_unit_size", "dmm_unit_complexity", "dmm_unit_interfacing"])
    data.iloc[5, 0] = np.nan
    df = spark.createDataFrame(data)
    filled = data.fillna(data.median())
    score = (1 - (filled - filled.min()) / (filled.max() - filled.min() + 1e-8)).mean(axis=1)
    row = quality.quality_score(df).first()
    assert np.allclose([row["mean_score"], row["median_score"], row["std_score"]], [score.mean(), score.median(), score.std(ddof=0)])
    bands = quality.quality_score_bands(df).first()
    assert sum(bands) == 60 and bands["excellent"] == (score >= 0.8).sum()
    weights = np.array([0.3, 0.4, 0.3])
    composite = ((data - data.min()) / (data.max() - data.min() + 1e-8)).to_numpy() @ weights
    row = quality.composite_dmm_score(df).first()
    assert np.allclose(row["std"], np.nanstd(composite, ddof=1))


def test_quality_of_empty_and_constant_columns(spark):
    df = dmm(spark, [(0.5, None, 0.1), (0.5, None, 0.2)])
    assert {r["metric"] for r in quality.dmm_metrics(df).collect()} == {"dmm_unit_size", "dmm_unit_interfacing"}
    assert {r["metric"] for r in quality.quality_classes(df).collect()} == {"dmm_unit_size", "dmm_unit_interfacing"}
    assert quality.quality_score_bands(dmm(spark, [])).first()["poor"] == 0


def test_higher_is_better(spark):
    df = dmm(spark, [(float(i), float(i), float(i)) for i in range(8)])
    low = {r["quality_class"]: r["commits"] for r in quality.quality_classes(df, ["dmm_unit_size"]).collect()}
    high = {r["quality_class"]: r["commits"] for r in quality.quality_classes(df, ["dmm_unit_size"], True).collect()}
    assert low["high"] == high["low"] and low["low"] == high["high"]


def test_clipping_needs_spread(spark):
    df = spark.createDataFrame([(1.0, 5.0)] * 9 + [(100.0, 5.0)], "insertions double, deletions double")
    # no interquartile range: the outlier stays
    assert features.clip_outliers_iqr(df).agg(F.max("insertions")).first()[0] == 100.0
    df = spark.createDataFrame([(float(i), 5.0) for i in range(9)] + [(100.0, 5.0)], "insertions double, deletions double")
    q1, q3 = np.quantile([*range(9), 100], [0.25, 0.75])
    assert features.clip_outliers_iqr(df).agg(F.max("insertions")).first()[0] == pytest.approx(q3 + 1.5 * (q3 - q1))


def test_standardize_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "insertions double, deletions double")
    assert [tuple(r) for r in features.standardize(df).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.mark.parametrize("short", [10**6, 3])
def test_label_codes(spark, monkeypatch, short):
    monkeypatch.setattr(features, "ONE_TASK_DICTIONARY", short)
    monkeypatch.setattr(features, "SMALL_DICTIONARY", short)
    names = [f"n{i % 37:02d}" for i in range(500)] + [None] * 300
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "hash string, author string").repartition(6)
    got = {r["hash"]: r["author"] for r in features.label_encode(df).collect()}
    ranks = {v: k for k, v in enumerate(sorted({n or "unknown" for n in names}))}
    assert got == {str(i): ranks[n or "unknown"] for i, n in enumerate(names)}


@pytest.mark.parametrize("method", [features.COOCCURRENCE, features.WORD2VEC])
def test_message_embeddings(spark, method):
    df = spark.createDataFrame([(i, f"word{i} fix bug") for i in range(50)] + [(99, None), (99, None), (98, " ")], "id int, msg string")
    out = features.message_embeddings(df, partitions=1, method=method).collect()
    assert len(out) == 53 and all(len(r["embedding"]) == 50 for r in out)
    assert not any(any(r["embedding"].toArray()) for r in out if r["id"] > 90)
    assert all(any(r["embedding"].toArray()) for r in out if r["id"] < 90)
    with pytest.raises(ValueError):
        features.message_embeddings(df, method="other")


def test_cooccurrence_factors(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.5, 12) % 40) for _ in range(120)] + [None, "", "alone"]
    df = spark.createDataFrame([(t,) for t in texts], "msg string").repartition(3)
    counts = {}
    for t in texts:
        t = (t or "").split()
        for i, a in enumerate(t):
            for b in t[i + 1 : i + 6]:
                for pair in ((a, b), (b, a)):
                    counts[pair] = counts.get(pair, 0) + 1
    found = embeddings.cooccurrences(df, "msg", 5)
    assert {(r["word"], r["context"]): r["n"] for r in found.collect()} == counts
    words = sorted({a for a, _ in counts})
    table = np.zeros((len(words), len(words)))
    for (a, b), n in counts.items():
        table[words.index(a), words.index(b)] = n
    with np.errstate(divide="ignore"):
        table = np.maximum(np.log(table * table.sum() / np.outer(table.sum(1), table.sum(0))), 0)
    # five components by iteration, and all of them exactly
    values = np.linalg.eigvalsh(table)
    values = values[np.argsort(-np.abs(values))]
    weights = embeddings.information_weights(found)
    for size, rounds, near in ((3, 12, 0.02), (len(words), 1, 1e-8)):
        vectors, spectrum = embeddings.factorised(weights, size, rounds=rounds)
        assert np.allclose(np.abs([v for v, _ in spectrum]), np.abs(values[: len(spectrum)]), atol=near * values[0])
        vec = {r["word"]: np.array(r["vec"]) for r in vectors.collect()}
        made = np.stack([vec[w] for w in words])
        scale = np.sqrt(np.abs([v for v, _ in spectrum])) + 1e-30
        unit = made[:, : len(spectrum)][:, scale > 1e-3] / scale[scale > 1e-3]
        assert np.allclose(unit.T @ unit, np.eye(unit.shape[1]), atol=1e-6)
        left = np.linalg.norm(table @ unit - unit * np.array([v for v, _ in spectrum])[scale > 1e-3], axis=0)
        assert np.allclose(left, np.array([r for _, r in spectrum])[scale > 1e-3], atol=1e-4)
    empty, none = embeddings.factorised(weights.filter("false"), 4)
    assert empty.collect() == [] and none == []


def test_running_totals_of_hot_groups(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"g": rng.choice(["a", "a", "a", "b", None], 900), "at": rng.integers(0, 3, 900), "id": [str(i) for i in range(900)],
                          "x": pd.array(rng.integers(0, 9, 900), dtype="Int64")})
    frame.loc[::7, "x"] = pd.NA
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "g string, at long, id string, x long")
    got = {r["id"]: r["total"] for r in running.running_totals(df, ["g"], ["at", "id"], {"total": "x"}).collect()}
    ordered = frame.sort_values(["at", "id"])
    want = ordered.assign(x=ordered["x"].fillna(0)).groupby(ordered["g"].fillna("none"))["x"].cumsum()
    assert got == dict(zip(ordered["id"], want))
    assert running.running_totals(df.filter("x > 100"), ["g"], ["at", "id"], {"total": "x"}).collect() == []


def test_quantiles_of_many_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 200, 3000), rng.normal(0, 1, 3000).round(1))] + [(None, 1.0), (None, 4.0), (500, None), (501, 7.0)]
    found = running.group_quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", [0.0, 0.3, 0.5, 1.0]).collect()
    assert len(found) == len({g for g, _ in rows})
    for r in found:
        values = [v for g, v in rows if g == r["g"] and v is not None]
        assert [r[f"q{i}"] for i in range(4)] == (pytest.approx(list(np.quantile(values, [0.0, 0.3, 0.5, 1.0]))) if values else [None] * 4)


def bits(key, seed=42):
    return int(hashlib.md5(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("step", [12, 4])
def test_stratified_split(spark, monkeypatch, step):
    monkeypatch.setattr(splits, "_STEP", step)
    label = lambda i: "all" if i % 3 else None if i < 300 else f"c{i % 97}"
    rows = [(str(i), label(i)) for i in range(7000)] + [("same", "copies")] * 50 + [("alone", "one"), (None, "no key")]
    df = spark.createDataFrame(rows, "hash string, label string")
    found = features.train_test_split(df, "hash", label="label").collect()
    assert len(found) == len(rows)
    for name in {x for _, x in rows}:
        keys = [k for k, x in rows if x == name]
        test = [r["hash"] for r in found if r["label"] == name and r["is_test"]]
        first = sorted(keys, key=bits)[: math.ceil(0.2 * len(keys))]
        assert sorted(test, key=str) == sorted((k for k in keys if bits(k) <= bits(first[-1])), key=str)
    every = features.train_test_split(df.filter("label = 'all'"), "hash", test=0.25).collect()
    assert sum(r["is_test"] for r in every) == math.ceil(0.25 * len(every))
    folds = {r["hash"]: r["fold"] for r in features.kfold(df.filter("label = 'all'"), "hash", 7).collect()}
    order = sorted(folds, key=bits)
    sizes = [len(order) // 7 + (i < len(order) % 7) for i in range(7)]
    assert [folds[k] for k in order] == [i for i, n in enumerate(sizes) for _ in range(n)]


def test_split_of_no_rows(spark):
    none = spark.createDataFrame([], "hash string, label string")
    assert features.train_test_split(none, "hash", label="label").collect() == []
    assert features.train_test_split(none, "hash").collect() == [] and features.kfold(none, "hash").collect() == []
    some = spark.createDataFrame([("a", "x"), ("b", "x")], "hash string, label string")
    assert not any(r["is_test"] for r in features.train_test_split(some, "hash", test=0.0, label="label").collect())
    assert sorted(r["fold"] for r in features.kfold(some, "hash", 5).collect()) == [0, 1]


def test_split_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(str(i),) for i in range(300)], "hash string")
    a = {r["hash"] for r in features.train_test_split(df.repartition(1), "hash").filter("is_test").collect()}
    b = {r["hash"] for r in features.train_test_split(df.repartition(8), "hash").filter("is_test").collect()}
    assert a == b


def test_column_selection(spark):
    df = spark.createDataFrame([(1, 2.0, 4.1, 7, "x"), (2, 3.0, 6.0, 7, "y"), (3, 9.0, 18.2, 7, "z")], "commit_id int, a double, b double, c int, t string")
    numeric = filters.numeric_columns(df)
    assert filters.exclude_id_like(numeric) == ["a", "b", "c"]
    assert filters.constant_columns(df, ["a", "b", "c"]) == ["c"]
    assert filters.correlated_columns(df, ["a", "b"]) == ["b"]


def test_wide_correlations_agree(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame(rng.random((80, 22)), columns=[f"x{i}" for i in range(22)])
    data.iloc[3, 1] = data.iloc[5, 20] = None
    found = filters.correlations(spark.createDataFrame(data), list(data.columns))
    expected = data.corr()
    assert all(abs(r - expected.loc[a, b]) < 1e-9 for (a, b), r in found.items())


def test_guards(spark):
    df = spark.createDataFrame([("a",)] * 9, "y string")
    assert filters.min_rows_guard(df) and filters.min_rows_guard(df.union(df)) is None
    assert filters.class_size_guard(df, "y") == "only one class"
    assert filters.class_size_guard(df.union(spark.createDataFrame([("b",)], "y string")), "y") == "a class has fewer than 2 rows"


def test_cumulative_churn_of_one_busy_project(spark):
    rows = [("p", f"{i:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * (i % 50)), i, 2 * i) for i in range(200)]
    df = spark.createDataFrame(rows, "project_name string, hash string, committer_date timestamp, insertions long, deletions long")
    got = {r["hash"]: r["cumulative_insertions"] for r in activity.cumulative_churn(df.repartition(5)).collect()}
    total, expected = 0, {}
    for _, h, at, ins, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        total += ins
        expected[h] = total
    assert got == expected
