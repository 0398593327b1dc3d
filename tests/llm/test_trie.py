"""The prefix trie: against a plain dictionary of prefixes, in one shard and in many, with spilling queues."""

import hashlib
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from commitlore.llm import trie
from commitlore.llm.queries import QUERIES, SQL

ROWS = "conv_id long, turn long, role string, text string, depth int, words string, node long, parent string"
NAMES = [c.split()[0] for c in ROWS.split(", ")]


def odd_rows(n=70):
    """Conversations with nulls, ties, repeated rows, shared beginnings, a long one, and ids beyond 2^53."""
    rng = random.Random(9)
    texts = ["hello there", "", None, "one", "two  words\n", "é", "a b c"]
    rows = []
    for conv in [*range(n), 2**53 + 1, 2**53 + 20, None]:
        for turn in sorted((rng.choice([None, 0, 1, 2, 3]) for _ in range(rng.randrange(1, 6))), key=lambda t: (t is not None, t or 0)):
            rows.append((conv, turn, rng.choice(["user", "user", None]), rng.choice(texts), 1, "x", 2, "y"))
    rows += [(41, 100 + k, "user", f"turn {k}", 1, "x", 2, "y") for k in range(50)]
    return rows


def plain_trie(rows):
    turns = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn, role or "", text or ""))
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    for conv in turns:
        turns[conv] = [v[1:] for v in sorted(turns[conv], key=lambda v: (v[0] is not None, v[0] or 0, v[1], digest(v[1], v[2])))]
    members, ends = {}, {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 4
        whole = tuple(turns.get(conv - conv % 20, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(conv)
        ends.setdefault(whole, []).append(conv)
    out = []
    for node, convs in members.items():
        children = [m for m in members if len(m) == len(node) + 1 and m[:-1] == node]
        subtree = [m for m in members if m[: len(node)] == node]
        leaves = [m for m in subtree if not any(len(x) == len(m) + 1 and x[:-1] == m for x in members)]
        saved = sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in subtree if m)
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaves), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(spark, rows, **given):
    turns = trie.turn_digests(spark.createDataFrame(rows, ROWS).repartition(3))
    return sorted((tuple(r) for r in trie.prefix_trie(trie.rebuilt(turns), **given).collect()), key=str)


@pytest.mark.parametrize("given", [{}, {"shard_turns": 3, "held": 2}, {"shard_turns": 40, "held": 1}])
def test_trie_matches_plain_prefixes(spark, given):
    rows = odd_rows()
    assert trie_rows(spark, rows, **given) == plain_trie(rows)


def test_many_ends_in_one_node_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 7)
    ids = [3, 20, 100, *range(200, 300)]
    ends = spark.createDataFrame([(b"a", i) for i in ids] + [(b"b", 5)], "node binary, conv_id long")
    want = {b"a": ",".join(map(str, ids)), b"b": "5"}
    assert {bytes(r["node"]): r["ends_sha256"] for r in trie.end_digests(ends).collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_spilling_queue_is_a_priority_queue(most):
    rng, queue, plain = random.Random(1), trie.SpillingQueue(most), []
    for _ in range(2000):
        if plain and rng.random() < 0.45:
            assert queue.least() == min(plain)
            plain.remove(queue.pop())
        else:
            item = (rng.randrange(50), rng.randrange(50))
            queue.push(item)
            plain.append(item)
    while plain:
        assert queue.least() == min(plain)
        plain.remove(queue.pop())
    assert queue.least() is None


def test_conversation_without_turns_and_empty_table(spark):
    # conversation 1 takes its first turns from conversation 0, which is absent, and has but one turn of its own
    h = zlib.crc32(b"1") % 4
    rows = [(1, 0, "user", "hi", 1, "x", 2, "y")]
    assert trie_rows(spark, rows) == plain_trie(rows)
    assert len(plain_trie(rows)) == (1 if h >= 1 else 2)
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(None, 0, "user", "hi", 1, "x", 2, "y")]) == []


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    frame = pd.DataFrame(odd_rows(200), columns=NAMES).astype({"conv_id": "Int64", "turn": "Int64"})
    frame.to_parquet(tmp_path / "conversations.parquet")
    found = QUERIES["op11_prefix_trie"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet'")
    want = con.sql(f"select {', '.join(found.columns)} from ({SQL['op11_prefix_trie']})").fetchall()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
