"""Nested records find their layout by the fingerprint of their fields, as JSON records do."""

import pytest
from pyspark.sql import functions as F

from commitlore.llm import chat


@pytest.mark.parametrize("kind, value", [
    ("messages array<struct<role:string,content:string>>", ([("user", "hi"), ("assistant", None), (None, "x")],)),
    ("data struct<dialog:array<struct<speaker:string,content:string>>>", (([("human", "hi"), ("gpt", "yes")],),)),
    ("prompt string, response string", ("ask", "answer")),
    ("question string, answer string", (None, "answer")),
    ("instruction string, input string, output string", ("do", "", "done")),
    ("instruction string, input string, output string", ("do", "this", "done")),
    ("unknown string, other array<int>", ("a", [1])),
])
def test_structs_are_read_as_json_is(spark, kind, value):
    df = spark.createDataFrame([value], kind)
    nested = df.select(F.struct(*df.columns).alias("record"))
    text = nested.select(F.to_json("record", {"ignoreNullFields": "false"}).alias("record"))
    (a,), (b,) = chat.canonical_structs(nested).select("layout", "turns").collect(), chat.canonical(text).select("layout", "turns").collect()
    assert a == b


def test_rows_go_through_the_fingerprint(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "yes"), (1, 0, "user", "ok?"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat.rows_to_chats(rows).collect()}
    assert found == {1: ("messages", [("user", "ok?"), ("assistant", "yes")]), None: ("messages", [("", "")])}
    assert chat.rows_to_chats(rows.filter("false")).collect() == []
    null = rows.limit(1).select(F.lit(None).cast("struct<messages:array<struct<role:string,content:string>>>").alias("record"))
    assert [tuple(r) for r in chat.canonical_structs(null).select("layout", "turns").collect()] == [(None, [])]


def test_spans_of_many_turns(spark):
    """Around the size of a block of turns, and far beyond, with characters of one to four bytes."""
    for n in (1, chat.BLOCK_TURNS, chat.BLOCK_TURNS + 1, 9000):
        turns = [("assistant" if i % 2 else "user", f"é😀 </s> {i} \\ x" if i % 3 else "") for i in range(n)]
        rows = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
        row = chat.read_back(chat.formatted(chat.rows_to_chats(rows)).select("formatted", "loss_spans")).first()
        assert [tuple(t) for t in row["read_turns"]] == turns
        assert row["loss_texts"] == [text for role, text in turns if role == "assistant"]
