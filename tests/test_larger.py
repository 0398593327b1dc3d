"""What must hold as tables grow: plans that hold no long table in one place, and results that do not depend on the form."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from commitlore.operators import embeddings, features, impact, lloyd, models, sums
from commitlore.plans import reports
from commitlore.registry import models as registered
from tools.check_queries import QUERIES, compare, connect


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_dictionary_is_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(features, "SMALL_DICTIONARY", 5)
    monkeypatch.setattr(features, "FREQUENT_SHARE", 10, raising=False)
    names = [f"n{i:03d}" for i in range(400)] + ["often"] * 300 + [None] * 100
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "hash string, author string").repartition(6)
    out = features.label_encode(df)
    ranks = {v: k for k, v in enumerate(sorted({n or "unknown" for n in names}))}
    assert {r["hash"]: r["author"] for r in out.collect()} == {str(i): ranks[n or "unknown"] for i, n in enumerate(names)}
    # the codes themselves meet their rows by a shuffle, whatever size the planner takes their file to have
    assert "SortMergeJoin [_value" in _plan(features.label_encode(df))


@pytest.fixture(scope="module")
def without_rules(tmp_path_factory, sf_dir):
    """The sample tables with one line in each order, so that no two files change together."""
    out = tmp_path_factory.mktemp("without_rules")
    for name in os.listdir(sf_dir):
        if name != "lineitem.parquet":
            os.symlink(os.path.join(sf_dir, name), out / name)
    first = "SELECT * FROM read_parquet('{}/lineitem.parquet') QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1"
    duckdb.sql(f"COPY ({first.format(sf_dir)}) TO '{out}/lineitem.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", ["association_network_metrics", "association_network_nodes", "mine_associations"])
def test_no_rules_as_sql(spark, without_rules, name):
    ok, message = compare(spark, connect(without_rules), name, without_rules)
    assert ok, message


def test_no_models_is_an_empty_table(spark, without_rules):
    scores = QUERIES["file_impact"](spark, without_rules)
    assert scores.columns == ["task", "model", "accuracy", "precision", "recall", "f1"] and scores.count() == 0
    one = spark.createDataFrame([(str(i), float(i), "a", 0.5) for i in range(20)], "hash string, x double, kind string, dmm_score double")
    found = models.train_classifiers(one, "kind")
    assert [found[k].count() for k in ("scores", "confusion", "importances", "classes", "skipped")] == [0, 0, 0, 0, 1]
    for cv in (models.cv_regression(one.limit(3)), models.cv_classification(one, "kind")):
        assert [cv[k].count() for k in ("scores", "folds", "importances", "skipped")] == [0, 0, 0, 1]


WHOLE = [
    ("file_impact", "file_impact", {}),
    ("predict_change_type", "train_classifiers", {}),
    ("cv_regression", "cv_regression", {}),
    ("cv_classification", "cv_classification", {}),
    ("train_regressors", "train_regressors", {}),
    ("predict_quality_class", "train_classifiers", {}),
    ("predict_file_type", "train_classifiers", {}),
]


@pytest.mark.parametrize("name, fit, wanted", WHOLE)
def test_registered_models_are_fitted_whole(spark, sf_dir, monkeypatch, name, fit, wanted):
    """As many trees, rounds and iterations as the library fits by default."""
    class Asked(Exception):
        pass

    def asked(*args, **options):
        raise Asked(options)

    monkeypatch.setattr(registered, "_features", lambda spark, sf_dir: features.dmm_score(spark.createDataFrame(
        [(str(i), float(i), "a", 0.1 * i, 0.1 * i, 0.1 * i) for i in range(9)], "hash string, x double, kind string, dmm_unit_size double, dmm_unit_complexity double, dmm_unit_interfacing double")))
    monkeypatch.setattr(models if hasattr(models, fit) else impact, fit, asked)
    with pytest.raises(Asked) as found:
        QUERIES[name](spark, sf_dir)
    options = found.value.args[0]
    assert {k: v for k, v in options.items() if k in ("trees", "rounds", "iterations", "max_models", "only")} == wanted
    assert (models.TREES, models.ROUNDS, models.ITERATIONS) == (100, 100, 100)


def test_the_whole_analysis_is_asked_for(spark, sf_dir, monkeypatch):
    """No step is switched off and no step cut short; the scores of all models are in the result."""
    asked = {}

    def found(*tables, **options):
        asked.update(options)
        one = spark.createDataFrame([("x", 1.0)], "task string, value double")
        return {"quality_raw": {"quality_score": one}, "quality_scaled": {"quality_score": one}, "associations": {"totals": one},
                "clusters": {"kmeans_sizes": one, "community_sizes": one, "evaluation": one}, "models": {}, "scoreboard": one}

    monkeypatch.setattr(reports, "analyze_commits", found)
    sections = {r["section"] for r in QUERIES["analyze_commits"](spark, sf_dir).collect()}
    assert asked == {} and {"clusters_community_sizes", "scoreboard"} <= sections


def test_scans_of_a_fit_read_blocks(spark, monkeypatch):
    """Rows are opened once for a fit, not in every scan."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (3000, 2)) for c in (0, 3, 9)])
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(3)
    read = []
    seen = sums.summed
    monkeypatch.setattr(lloyd, "summed", lambda held, *a: (read.append((held.columns, held.count())), seen(held, *a))[1])
    centers, inertia = lloyd.fit_all(rows, [3], 4)[3]
    assert np.allclose(sorted(centers[:, 0]), [0, 3, 9], atol=0.05) and inertia == pytest.approx(((x - np.round(x / 3) * 3) ** 2).sum(), rel=0.01)
    assert len(read) > 2 and all(columns == ["n", "x"] and 1 < n < 10 for columns, n in read)
    total = sums.summed(spark.createDataFrame([([1.0, 2.0], 3.0)], "x array<double>, y double"), 1, lambda x, y: (x.sum(axis=1) * y)[:1])
    assert total.tolist() == [9.0] and sums.summed(rows.limit(0), 2, lambda x, y: x).tolist() == [0.0, 0.0]


def test_blocks_and_their_batches_are_short(spark, monkeypatch):
    """A reader holds a page of blocks, a worker a batch of them, so neither may grow with the width of the rows."""
    rows = spark.createDataFrame([([float(i)] * 100,) for i in range(2000)], "x array<double>").coalesce(1)
    monkeypatch.setattr(sums, "BATCH_BLOCKS", 2)
    with sums.blocks(rows) as held:
        assert held.selectExpr("max(length(x))").first()[0] <= 1 << 17
        with sums.few_blocks(spark):
            batches = held.mapInPandas(lambda frames: (pd.DataFrame({"n": [len(f)]}) for f in frames), "n int").collect()
    assert len(batches) > 5 and max(r["n"] for r in batches) == 2


def test_word_pairs_are_shuffled_once(spark):
    texts = [(t,) for t in ("a b a a", "b c", None, "", "c", "d d d a b c e f g h")]
    df = spark.createDataFrame(texts, "msg string")
    want = {}
    for (t,) in texts:
        t = (t or "").split()
        for i, a in enumerate(t):
            for b in t[i + 1 : i + 6]:
                for pair in ((a, b), (b, a)):
                    want[pair] = want.get(pair, 0) + 1
    counts = embeddings.cooccurrences(df, "msg", 5)
    assert {(r["word"], r["context"]): r["n"] for r in counts.collect()} == want
    assert _plan(embeddings.cooccurrences(df, "msg", 5)).count("Exchange hashpartitioning") == 1
    held = {(r["word"], r["context"]): (r["n"], r["value"]) for r in embeddings.weighted_cooccurrences(df, "msg", 5).collect()}
    values = {(r["word"], r["context"]): r["value"] for r in embeddings.information_weights(counts).collect()}
    assert held.keys() == want.keys() and {k: v for k, (_, v) in held.items() if v is not None} == pytest.approx(values)
    assert {k: n for k, (n, _) in held.items()} == want


def test_context_vectors_by_blocks_and_ranges(spark, monkeypatch):
    """Blocks and ranges of a few words give what the whole table gives, and no text or word is left out."""
    from commitlore.operators import contexts

    monkeypatch.setattr(contexts, "BLOCK_TOKENS", 150)
    monkeypatch.setattr(contexts, "RANGE_TOKENS", 400)
    monkeypatch.setattr(contexts, "STEP_TOKENS", 7)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.6, 14) % 30) for _ in range(120)] + [None, "", "alone", "w1 " * 200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, msg string").repartition(3)
    words = sorted({w for t in texts for w in (t or "").split()})
    table = np.zeros((len(words), len(words)))
    for t in texts:
        t = [words.index(w) for w in (t or "").split()]
        for i, a in enumerate(t):
            for b in t[max(0, i - 5) : i] + t[i + 1 : i + 6]:
                table[a, b] += 1
    totals = table.sum(1)
    scale = 1 / np.sqrt(totals + totals.mean())
    values, axes = np.linalg.eigh(table * np.outer(scale, scale))
    order = np.argsort(-np.abs(values))
    size = len(words)
    vectors = scale[:, None] * axes[:, order] * np.sqrt(np.abs(values[order]) * totals.sum())
    rows = spark.createDataFrame(df.toPandas().assign(_row=range(len(texts)))).repartition(3)
    blocks = contexts.token_blocks(rows, "msg")
    assert blocks.count() > 3 and contexts.range_bits(blocks) >= 2
    state, spectrum = contexts.context_vectors(blocks, size, 5)
    assert np.allclose(np.abs(spectrum), np.abs(values[order])[: len(spectrum)], atol=1e-4)
    means = {r["id"]: np.array(r["embedding"]) for r in rows.join(contexts.text_means(blocks, state, size), "_row").collect()}
    assert len(means) == len(texts) and not means[120].any() and not means[121].any()
    expected = np.stack([np.mean([vectors[words.index(w)] for w in t.split()] or [np.zeros(size)], axis=0) for t in texts if t is not None])
    made = np.stack([means[i] for i, t in enumerate(texts) if t is not None])
    # signs of components are free, and so is the choice within equal ones: products of vectors are not
    assert np.allclose(made @ made.T, expected @ expected.T, atol=2e-3 * np.abs(expected @ expected.T).max())


def test_document_embeddings_hold_no_vocabulary_on_the_driver(spark, sf_dir, monkeypatch):
    def gathers(*_, **__):
        raise AssertionError("a model on the driver")

    monkeypatch.setattr(features, "Word2Vec", gathers)
    assert QUERIES["document_embeddings"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_classifiers_share_one_set_of_blocks(spark, monkeypatch):
    """Support vectors and network are fitted on the same few numbers a row; kernel features are never written."""
    from contextlib import contextmanager

    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from commitlore.operators import descent

    rng = np.random.default_rng(4)
    rows = [(float(i % 3), (rng.normal(0, 0.4, 2) + [i % 3, -(i % 3)]).tolist()) for i in range(300)]
    data = spark.createDataFrame(rows, "label double, x array<double>").select("label", array_to_vector(F.col("x")).alias("features"))
    written = []

    @contextmanager
    def counted(frame):
        with sums.blocks(frame) as held:
            written.append(max(len(r["x"]) // r["n"] for r in held.collect()))
            yield held

    monkeypatch.setattr(descent, "blocks", counted)
    good = {}
    for name, predicted, _ in models.fit_classifiers(data, data, ["a", "b"], 3, iterations=30, layers=[8], only=["SVM", "MLP"]):
        good[name] = predicted.filter("label = prediction").count() / len(rows)
    assert written == [16] and min(good[n] for n in ("SVM", "MLP")) > 0.9

    loss, at = descent.softmax_loss([2, 4, 3]), rng.normal(size=2 * 4 + 4 + 4 * 3 + 3)
    x, y = rng.normal(size=(20, 2)), rng.integers(0, 3, 20)
    slope = [(loss(at + 1e-6 * e, x, y)[0] - loss(at - 1e-6 * e, x, y)[0]) / 2e-6 for e in np.eye(len(at))]
    assert np.allclose(loss(at, x, y)[1], slope, atol=1e-5)


@pytest.mark.parametrize("small", [50_000, 3])
def test_means_of_texts_need_no_group_a_text(spark, monkeypatch, small):
    from commitlore.operators import contexts

    monkeypatch.setattr(embeddings, "SMALL_VOCABULARY", small, raising=False)
    monkeypatch.setattr(contexts, "STEP_TOKENS", 4)
    monkeypatch.setattr(contexts, "RANGE_TOKENS", 100)
    vec = {f"w{i}": [float(i), 1.0, -i / 2] for i in range(8)}
    texts = ["w1 w2 w2", None, "", "unknown", "w7 unknown w3 w3 w5 w1", *(f"w{i % 8} w{i % 3} w{i % 5}" for i in range(100)), "w4 " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, msg string").repartition(2)
    vectors = spark.createDataFrame(list(vec.items()), "word string, vec array<double>")
    out = embeddings.mean_vectors(df, "msg", vectors, 3)
    made = {r["id"]: r["embedding"] for r in out.collect()}
    assert len(made) == len(texts)
    for i, t in enumerate(texts):
        words = (t or "").split()
        expected = np.mean([vec.get(w, [0.0] * 3) for w in words] or [[0.0] * 3], axis=0)
        assert np.allclose(made[i], expected, atol=1e-6)
    assert "HashAggregate" not in _plan(out)
