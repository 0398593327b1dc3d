"""Ids beyond 2^53 beside a null id, and columns named like results, come through every operator and stage whole."""

import pytest

import corpus_pipeline
from commitlore.llm import bpe, contamination, fingerprint, langid, lm, mixing, near_dup, packing, passages, toxicity

A, B = 2**53 + 1, 2**53 + 3
PASSAGE = " ".join(f"word{i}" for i in range(80))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(A, PASSAGE + " " + " ".join(f"one{i}" for i in range(60)), "en", "a", 77.0, 2**60 + 1, True), (None, "no id at all here", "en", "a", None, None, None),
            (B, PASSAGE + " " + " ".join(f"two{i}" for i in range(60)), "en", "b", 78.5, 2**60 + 3, False)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, other long, flag boolean").coalesce(1)


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda i: (i is None, i or 0))


def test_ids_of_operators(spark, docs):
    everywhere = [A, B, None]
    model = langid.fit_languages(docs)
    found = langid.languages(docs, model)
    assert ids(found) == everywhere and {(r["doc_id"], r["other"], r["flag"]) for r in found.collect()} == {(A, 2**60 + 1, True), (B, 2**60 + 3, False), (None, None, None)}
    labels = spark.createDataFrame([(A, 1), (B, 0)], "doc_id long, toxic int")
    assert ids(toxicity.toxic_scores(docs, toxicity.fit_toxicity(docs, labels))) == everywhere
    benchmark = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert ids(contamination.contamination(docs, benchmark)) == everywhere
    assert ids(fingerprint.fingerprints(docs)) == everywhere
    assert ids(fingerprint.neighbours(docs)) == everywhere
    assert ids(near_dup.near_duplicates(docs)) == everywhere
    assert ids(near_dup.deduplicated(docs)) == everywhere
    assert sorted((i for r in packing.pack(docs).collect() for i in r["doc_ids"]), key=str) == sorted(everywhere, key=str)
    assert ids(mixing.mix_plan(docs)) == everywhere
    vocabulary = packing.VOCABULARY
    assert ids(bpe.encode(docs, vocabulary, packing.PATTERN)) == everywhere


def test_order_of_large_ids_beside_a_null(docs):
    rows = {r["doc_id"]: r["n_chars"] for r in fingerprint.neighbours(docs).collect()}
    assert rows == {r["doc_id"]: len(r["text"]) for r in docs.collect()}


def test_stages_keep_ids_and_columns(spark, docs):
    more = [(i, f"another text {i} in plain words", "en", "a", None, None, None) for i in range(9)]  # so that some are not held out
    whole = docs.unionByName(spark.createDataFrame(more, docs.schema)).coalesce(1)
    for name, step in corpus_pipeline.STAGES[:2]:
        found = step(spark, whole, "")
        assert found.columns == docs.columns, name
        assert {(r["doc_id"], r["score"], r["other"], r["flag"]) for r in found.filter("doc_id is null or doc_id > 100").collect()} == {
            (A, 77.0, 2**60 + 1, True), (B, 78.5, 2**60 + 3, False), (None, None, None, None)}, name


def test_signs_that_are_no_letters_have_no_language(spark, docs):
    odd = spark.createDataFrame([(1, "½ ② Ⅷ"), (2, "12 !!"), (3, "é")], "doc_id long, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.languages(odd, langid.fit_languages(docs)).collect()}
    assert found[1] == found[2] == langid.UNKNOWN and found[3] == "en"


def test_passages_and_scores_keep_ids(docs):
    assert {A, B} <= {i for r in passages.repeated_passages(docs).collect() for i in r.asDict().values() if isinstance(i, int) and i >= A}
    role = lm.MAIN
    from pyspark.sql import functions as F

    assert ids(lm.model_scores(docs.select("doc_id", "text", F.lit(role).alias("role")))) == [A, B, None]
