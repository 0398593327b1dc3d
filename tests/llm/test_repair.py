"""Conversation repair: against every sequence of edits, against SQL, in memory and through files."""

import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest

from commitlore.llm import repair
from commitlore.llm.queries import QUERIES, SQL

ROWS = "conv_id long, turn long, role string, text string, seen string, edit int, conversation long, kind long"
EMPTY = hashlib.sha256(b"").hexdigest()


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        told = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def plain_edits(rows, kinds):
    """(cost, edits, mended rows) by trying every edit of every row, with up to two rows put in at every place."""
    best = None
    inserts = ["", "I", "II"]

    def legal(roles):
        s = "".join(roles)
        s = s[1:] if s.startswith("s") and len(s) > 1 else s
        return s == "ua" * (len(s) // 2)

    def walk(i, state, cost, audit, mended):
        nonlocal best
        if best and cost > best[0]:
            return
        for put in inserts:
            now, done, paid = list(mended), state, cost
            for _ in put:
                role = "assistant" if done == "u" else "user"
                now.append((role, ""))
                done, paid = role[0], paid + 5
            if i == len(rows):
                if legal([r[0][:1] for r in now]) and (best is None or (paid, audit + put) < best[:2]):
                    best = (paid, audit + put, now)
                continue
            _, role, text = rows[i]
            extra = 5 if kinds[i] == "truncated" else 0
            walk(i + 1, done, paid + 2, audit + put + "D", now)
            if kinds[i] in ("blank", "duplicate"):
                continue
            first = role[:1]
            if (first, done) in (("s", ""), ("u", ""), ("u", "s"), ("u", "a"), ("a", "u")):
                walk(i + 1, first, paid + extra, audit + put + "K", [*now, (role, text)])
            other = "assistant" if done == "u" else "user"
            walk(i + 1, other[0], paid + 1 + extra, audit + put + "R", [*now, (other, text)])

    walk(0, "", 0, "", [])
    return best


def plain_audit(rows):
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    kinds = plain_faults(rows)
    cost, audit, mended = plain_edits(rows, kinds)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in mended).encode()).hexdigest())


def by_conversation(df):
    return {r["conversation"]: tuple(r)[1:] for r in df.collect()}


def odd_rows(n=60):
    """Conversations with ties, nulls, repeats, blanks, unended texts and roles of all kinds."""
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", None, "", "unknown", "s", "a"]
    texts = ["Yes.", "No!", "cut off", " \t", "", None, "What?\n ", "B 0xf", "é?"]
    rows = []
    for conv in [*range(n), None]:
        for _ in range(rng.randrange(1, 7)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 9, 2**53 + 1, 2**53 + 2]), rng.choice(roles), rng.choice(texts), "x", 1, 7, 8))
    return rows


@pytest.mark.parametrize("held", [repair.HELD_CHARS, 0])
def test_audits_match_every_sequence_of_edits(spark, held):
    rows = odd_rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # conversations reach over batches
    try:
        got = by_conversation(repair.audits(repair.repaired(spark.createDataFrame(rows, ROWS), held)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for conv in {r[0] for r in rows}:
        want[None if conv is None else str(conv)] = plain_audit([(t, r, x) for c, t, r, x, *_ in rows if c == conv])
    assert got == want


def test_mended_rows_keep_their_texts(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "user", "Again?"), (1, 3, "assistant", "Yes."), (1, 4, "user", "")]
    mended = [tuple(r) for r in repair.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert [(r[2], r[3], r[4], r[7]) for r in mended] == [
        (0, "system", "Be kind.", "K"), (None, None, "Hi?", "D"), (1, "user", "Again?", "K"), (2, "assistant", "Yes.", "K"), (None, None, "", "D")]


def test_a_giant_conversation_goes_through_files(spark):
    n = 30_000
    rows = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id, '.') as text")
    (found,) = repair.audits(repair.repaired(rows, held_chars=50_000)).collect()
    text = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:turn {i}." for i in range(n))
    assert found["audit"] == "K" * n and found["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_damage(spark):
    rows = odd_rows()
    got = sorted((tuple(r) for r in repair.damaged(spark.createDataFrame(rows, ROWS)).collect()), key=str)
    want = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        want += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(want, key=str)


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    frame = pd.DataFrame(odd_rows(200), columns=[c.split()[0] for c in ROWS.split(", ")]).astype({"conv_id": "Int64", "turn": "Int64"})
    frame.to_parquet(tmp_path / "conversations.parquet")
    found = QUERIES["op12_conversation_repair"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet'")
    want = con.sql(f"select {', '.join(found.columns)} from ({SQL['op12_conversation_repair']})").fetchall()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_empty_table_and_conversations_that_lose_all_rows(spark):
    none = spark.createDataFrame([], ROWS)
    assert repair.conversation_audits(none, none).collect() == []
    some = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 1, 1, 1), (None, 0, "user", "Hi.", "x", 1, 1, 1)], ROWS)
    assert sorted((tuple(r) for r in repair.conversation_audits(none, some).collect()), key=str) == [(1, *[0] * 6, "", EMPTY), (None, *[0] * 6, "", EMPTY)]
