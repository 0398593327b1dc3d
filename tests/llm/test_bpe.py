"""Byte pairs: against the tiktoken library and against merging pair by pair; decoding gives the text back."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from commitlore.llm import bpe
from commitlore.llm.common import table
from commitlore.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(VOCABULARY)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_merges(word, ranks):
    """Pair by pair: the least rank of all neighbours, leftmost first."""
    if word in ranks:
        return [ranks[word]]
    parts = [bytes([b]) for b in word]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges(ranks):
    rng = random.Random(3)
    words = ["", "a", "aaaaaaaaaa", "antidisestablishmentarianism", "漢字漢字", " \n\n", "'ll", "abcabcabcabd" * 5]
    words += ["".join(rng.choice("abnd éßer漢ti") for _ in range(rng.randrange(1, 25))) for _ in range(500)]
    for word in words:
        assert bpe.merged(word.encode(), ranks) == plain_merges(word.encode(), ranks)


def test_pattern_knows_the_characters_of_the_library():
    import regex

    single = {bytes([b]): b for b in range(256)}
    every = "".join(f"a{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for name in (r"\p{L}", r"\p{N}", r"\s", r"\S", r"[^\s\p{L}\p{N}]"):
        theirs = bytes(tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        assert "".join(regex.findall(bpe.split_pattern(name), every)) == theirs


@pytest.mark.parametrize("block_chars", [300, bpe.BLOCK_CHARS])
def test_texts_of_odd_characters_match_the_library(spark, library, tmp_path, block_chars):
    rng = random.Random(4)
    signs = [" ", " ", " ", "\n", "\t", " ", " ", "a", "B", "1", "½", "'", "s", "'ll", ".", "é", "漢", "\x1c", "\x85", "\U00010ee7", "🙂", "é"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    texts += ["x" * 20_000 + " " * 5000, None, "", " ", "a  ", "   a", "</s><|endoftext|>", "same", "same"]
    rows = [(None if i % 7 == 0 else 2**53 + i // 2, t, "x", i, b"y", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, block int, word binary, decoded int").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    encoded = bpe.encode(docs, VOCABULARY, PATTERN, block_chars)
    got = Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in bpe.decode(encoded, VOCABULARY).collect())
    want = Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in rows)
    assert got == want


def test_each_distinct_word_is_encoded_once(spark, monkeypatch):
    words = spark.createDataFrame([(k, w) for k, w in enumerate([b" the"] * 50 + [b"rare", None])], "at long, word binary")
    calls = spark.sparkContext.accumulator(0)
    real = bpe.merged

    def counted(word, ranks):
        calls.add(1)
        return real(word, ranks)

    monkeypatch.setattr(bpe, "merged", counted)
    assert len(bpe.word_ids(words, VOCABULARY).collect()) == 52
    assert calls.value == 2


def test_documents_that_change_between_readings_are_an_error(spark):
    docs = spark.range(200, numPartitions=1).selectExpr("id as doc_id", "cast(rand() as string) as text")  # the same both times
    assert bpe.encode(docs, VOCABULARY, PATTERN).count() == 200
    words = bpe.block_words(spark.createDataFrame([(1, "one two")], "doc_id long, text string").coalesce(1), PATTERN)
    other = bpe.block_positions(spark.createDataFrame([(1, "one six")], "doc_id long, text string").coalesce(1), PATTERN)
    assert words.filter("word is null").first()["at"] != other.first()["check"]


def test_decoding(spark, library):
    some = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] and bytes(r["decoded"]) for r in bpe.decode(some, VOCABULARY).collect()}
    assert got == {1: library.decode_bytes([1, 2, 3]), 2: bytearray(), 3: None}
    with pytest.raises(Exception, match="no token"):
        bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), VOCABULARY).collect()


def test_query_and_empty_table(spark, sf_dir, library, no_docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_byte_pairs"](spark, sf_dir).collect()}
    for row in table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        ids, text = library.encode_ordinary(row["text"] or ""), (row["text"] or "").encode()
        assert got[row["doc_id"]] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest())
    assert bpe.decode(bpe.encode(no_docs, VOCABULARY, PATTERN), VOCABULARY).collect() == []
