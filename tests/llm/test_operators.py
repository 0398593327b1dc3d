"""The text operators against brute force, exact round trips and held-out accuracy, and on odd rows."""

import hashlib
import itertools
import math
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from commitlore.llm import chat, contamination, fingerprint, graph, langid, lm, mixing, near_dup, packing, passages, toxicity
from commitlore.llm.common import encoded, fold, plain_words, sampled_texts, table
from commitlore.session import release


def words(text):
    return (text or "").encode().lower().split()


# --- mixing


def test_mix_takes_exactly_each_budget(spark, sf_dir):
    rows = mixing.mix_plan(table(spark, sf_dir, "documents")).collect()
    for _, group in itertools.groupby(sorted(rows, key=lambda r: r.source), lambda r: r.source):
        group = list(group)
        assert sum(r.taken for r in group) == math.floor(group[0].target)
        assert all(r.taken <= 2 * r.size for r in group)


def test_mixed_texts_hold_the_taken_words(spark, odd_docs):
    taken = mixing.mix_plan(odd_docs).agg(F.sum("taken")).first()[0]
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns
    assert sum(len(words(r.text)) for r in out.collect()) == taken


def test_targets_share_excess_by_weight(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 0), (None, 50)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # weights a 3, b 1, c 2, null 3; 240 words, limits 20, 200, 0, 100
    assert got == {"a": 20, "b": pytest.approx(120), "c": 0, None: 100}


def test_mix_of_odd_and_no_rows(odd_docs, no_docs):
    assert mixing.mix_plan(odd_docs).count() == odd_docs.count()
    assert mixing.mix_plan(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


# --- language


def test_network_gradients():
    rng = np.random.default_rng(0)
    hidden, n = 3, 4
    p = [rng.normal(0, 0.3, s) for s in ((256, 3 * hidden), (hidden, 2 * hidden), (hidden, hidden))]
    x, goal = rng.integers(0, 256, (5, n)), rng.normal(size=(5, n, hidden))
    kept = []
    langid._run(x, p, kept)
    grads = langid._back(x, p, kept, goal.astype(np.float32))
    for g, w, at in ((grads[1], p[1], (1, 2)), (grads[2], p[2], (0, 1)), (grads[0], p[0], (int(x[0, 0]), 4))):
        ends = []
        for step in (1e-3, -1e-3):
            w[at] += step
            ends.append(float((langid._run(x, p) * goal).sum()))
            w[at] -= step
        assert g[at] == pytest.approx((ends[0] - ends[1]) / 2e-3, rel=0.05, abs=1e-3)


def test_language_on_held_out_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs, fold("doc_id", 3) != 1)
    out = langid.languages(docs.filter(fold("doc_id", 3) == 1), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.85
    states = langid._run(np.frombuffer(b"whole text here!" * 3, np.uint8).reshape(48, 1), model["weights"][:3])
    assert states.shape[0] == langid.SEGMENT


def test_samples_pass_over_long_texts(spark):
    docs = spark.createDataFrame([(i, f"text {i}" if i % 3 else f"{i} " + "x" * 2000, "en") for i in range(30)], "doc_id long, text string, lang string")
    got = [t for t, _ in sampled_texts(docs, "lang", 30, most_chars=1000)]
    assert sorted(got) == sorted(f"text {i}" for i in range(30) if i % 3)
    assert [len(t) for t, _ in sampled_texts(docs.filter("doc_id % 3 = 0"), "lang", 30, most_chars=1000)] == [1000]
    assert len(sampled_texts(docs, "lang", 30)) == 30


def test_language_of_odd_rows(odd_docs, no_docs):
    model = langid.fit(["the cat and the dog", "der hund und die katze"], ["en", "de"], epochs=1, least_steps=1)
    got = {r.doc_id: r for r in langid.languages(odd_docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 8)) and got[5].lang_pred in ("en", "de")
    assert langid.languages(no_docs, model).count() == 0
    assert langid.fit_languages(no_docs)["classes"] == []


# --- toxicity


def test_messages_equal_brute_force():
    rng = np.random.default_rng(1)
    odds, t = rng.uniform(0.2, 4, 9), rng.uniform(0.5, 2, (2, 2))
    got = toxicity.marginals(odds, np.array([4, 0, 5]), t)
    for start, n in ((0, 4), (4, 5)):
        total, ones = 0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            p = np.prod([odds[start + i] for i in range(n) if tags[i]]) * np.prod([t[a, b] for a, b in zip(tags, tags[1:])])
            total += p
            ones += p * np.array(tags)
        assert np.allclose(got[start : start + n], ones / total)


def test_toxic_spans_and_scores(spark):
    rng = np.random.default_rng(2)
    plain = [f"p{i}q" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        text = list(rng.choice(plain, 30))
        if i % 4 == 0:
            text[int(rng.integers(30))] = rng.choice(["Grunt!", "wortling", "wortlest", "wortlum"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, marks, F.col("doc_id") < 300)
    fresh = [(1000, "p1q wortlok p2q"), (1001, "p1q p2q"), (1002, "x GRUNT, y"), (1003, None)]
    got = {r.doc_id: r for r in toxicity.toxic_scores(docs.filter("doc_id >= 300").unionByName(spark.createDataFrame(fresh, docs.schema)), model).collect()}
    assert all((got[i].score >= 0.5) == (i % 4 == 0) for i in range(300, 400))
    assert [got[i].score >= 0.5 for i in (1000, 1001, 1002, 1003)] == [True, False, True, False]
    assert [(s.start, s.end) for s in got[1002].toxic_spans] == [(2, 7)] and got[1003].toxic_spans == []


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    marks = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(odd_docs, marks)
    assert toxicity.toxic_scores(odd_docs, model).filter("score between 0 and 1").count() == odd_docs.count()
    assert toxicity.toxic_scores(no_docs, toxicity.fit_toxicity(no_docs, marks)).count() == 0


# --- packing


def test_best_fit_equals_plain_best_fit():
    rng = np.random.default_rng(3)
    for room in (7, 64, 100):
        lengths = rng.integers(1, room + 1, 300).tolist()
        left: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, r in enumerate(left) if r >= n]
            if fits:
                left[min(fits, key=lambda i: left[i])] -= n
            else:
                left.append(room - n)
        bins = packing.best_fit(lengths, room)
        assert sorted(room - sum(lengths[i] for i in b) for b in bins) == sorted(left)
        assert sorted(i for b in bins for i in b) == list(range(300))


def test_tokens_equal_the_library():
    with open(packing.VOCABULARY, "rb") as file:
        tokens = packing.Tokens(file.read())
    for text in ("", " ", "a  b", "a \n b", " \n b", "x\n\n y", "it's 's  it", "é ü 漢字 12.5%", "a  b", "end.\nNew, one!", "tab\t x"):
        assert tokens.encode(text).tolist() == [*tokens.codec.encode_ordinary(text), tokens.end]


def test_packing_loses_nothing(odd_docs, no_docs):
    rows = packing.pack(odd_docs, row_tokens=64).collect()
    ids, positions = packing.matrices(rows, 64)
    with open(packing.VOCABULARY, "rb") as file:
        tokens = packing.Tokens(file.read())
    parts: dict = {}
    for r, line, place in zip(rows, ids, positions, strict=True):
        for k, (doc, part) in enumerate(zip(r.doc_ids, r.parts, strict=True)):
            a, b = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            assert place[a] == r.position_starts[k] == 64 * part
            parts.setdefault(doc, []).append((part, line[a:b].tolist()))
    for r in odd_docs.collect():
        if r.doc_id != 1:  # stands there twice
            assert tokens.decode(sum((p for _, p in sorted(parts[r.doc_id])), [])) == (r.text or "")
    assert len(parts[1]) == 2 and packing.pack(no_docs).count() == 0


# --- language model


def test_scores_equal_brute_force(spark, sf_dir):
    f = fold("doc_id", 5)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(f == 1, 2).when(f == 0, 1).otherwise(0).alias("role"))
    got = {r.doc_id: r for r in lm.model_scores(docs).collect()}
    count = Counter()
    rows = docs.collect()
    for r in rows:
        if r.role != lm.SCORED:
            count.update([*words(r.text), None])
    n, v = sum(count.values()), len(count)
    for r in rows:
        own = [*words(r.text), None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        x = got[r.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert x.base_score == pytest.approx(base)
    held = [x for x in got.values() if x.role == lm.SCORED]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)


def test_probabilities_sum_to_one(spark):
    rows = [(1, "a b a b c", 0), (2, "b a c", 1), (3, "a", 2), (4, "b", 2), (5, "c", 2), (6, "zz", 2), (7, None, 2)]
    got = {r.doc_id: r.score for r in lm.model_scores(spark.createDataFrame(rows, "doc_id long, text string, role int")).collect()}
    # from the start: a, b, c, an unknown word or the end; the second token is the end each time, so take it out by ratio
    assert all(s < 0 for s in got.values()) and 10 ** got[7] < 1


def test_mixture_weights_raise_likelihood():
    cells = {(1, -10, -40): 50, (1, 1, -30): 20, (2, -5, -50): 70, (2, 1, 1): 3}
    w = lm.learn_mixture(cells, 1e-3)
    assert np.allclose(w.sum(1), 1) and w[2][0] > 0.5 > w[2][1]
    assert lm.learn_mixture({}, 1.0)[0].tolist() == [0, 0, 1]


def test_scores_of_odd_rows(odd_docs, no_docs):
    out = lm.model_scores(odd_docs.withColumn("role", F.lit(0))).collect()
    assert len(out) == odd_docs.count() and sum(r.doc_id is None for r in out) == 1
    assert lm.model_scores(no_docs.withColumn("role", F.lit(0))).count() == 0


# --- chats


def test_layouts_become_the_same_turns(spark):
    records = [
        '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}', '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"prompt": "q", "response": "a"}', '{"completion": "a", "prompt": "q"}', '{"instruction": "q", "output": "a", "id": 5}', '{"data": {"dialog": [{"speaker": "user", "content": "q"}, {"speaker": "bot", "content": "a"}]}}',
        '{"question": "q", "answer": "a"}', '{"instruction": "q", "input": "", "output": "a"}',
    ]
    out = chat.canonical(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    assert all([tuple(t) for t in r.turns] == [("user", "q"), ("assistant", "a")] for r in out), [(r.record, r.turns) for r in out]
    odd = ['{"other": 1}', "no json", None, "[1]", '{"messages": []}', '{"messages": "text"}']
    assert all(r.turns == [] for r in chat.canonical(spark.createDataFrame([(r,) for r in odd], "record string")).collect())


def test_formatted_texts_read_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "\\", "\\\\<s>", "[\\INST]", "<", "", "<<SYS>>\\n", "a\nb", "$1 \\1"]
    rows = [(c, i, r, t) for c in (1, 2) for i, (r, t) in enumerate((r, t) for t in nasty for r in ("user", "assistant", "so me\nrole", None))]
    rows += [(3, None, None, None), (4, 1, "assistant", "x"), (4, 1, "assistant", "x")]
    chats = chat.canonical(chat.rows_to_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for r in chat.read_back(chat.formatted(chats)).collect():
        mine = sorted(((t if t is not None else -1, ro or "", te or "") for c, t, ro, te in rows if c == r.conv_id))
        assert [tuple(t) for t in r.read_turns] == [x[1:] for x in mine]
        assert list(r.loss_texts) == [x[2] for x in mine if x[1] == "assistant"]


def test_long_turns_are_not_lost(spark):
    long = spark.createDataFrame([(1, 0, "human", "q"), (1, 1, "gpt", None)], "conv_id long, turn long, role string, text string")
    long = long.withColumn("text", F.coalesce("text", F.repeat(F.lit("ab"), chat.PARSED_CHARS // 2 + 1)))
    (row,) = chat.formatted(chat.rows_to_chats(long)).select("layout", F.transform("turns", lambda t: F.struct(t["role"], F.length(t["text"]))).alias("turns"), "loss_spans").collect()
    assert row.layout == "messages" and [tuple(t) for t in row.turns] == [("user", 1), ("assistant", chat.PARSED_CHARS + 2)]
    assert [s.length for s in row.loss_spans] == [chat.PARSED_CHARS + 2]
    with pytest.raises(Exception, match="too long for the JSON parser"):
        chat.canonical(chat.rows_to_records(long)).select(F.size("turns")).collect()


def test_rows_become_the_turns_of_their_records(spark):
    rows = [(1, 2, "gpt", "a"), (1, 1, "human", None), (1, None, None, "x\\"), (None, 1, "assistant", "y"), (2, 1, "user", "")]
    rows = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got, want = ({r.conv_id: (r.layout, r.turns) for r in t.collect()} for t in (chat.rows_to_chats(rows), chat.canonical(chat.rows_to_records(rows))))
    assert got == want


# --- fingerprints


def test_levels_equal_counted_entropy():
    rng = np.random.default_rng(4)
    data = np.frombuffer(b"some words of text, again some words " * 9 + rng.integers(0, 256, 300, dtype=np.uint8).tobytes(), np.uint8)
    for i, level in enumerate(fingerprint.window_levels(data)):
        p = np.bincount(data[i : i + 64])
        p = p[p > 0] / 64
        assert abs(level - 1000 * -(p * np.log2(p)).sum() / 6) <= 1


def test_digests_do_not_depend_on_neighbours():
    raw = encoded(["a short one", "x" * 500, " ".join(f"word{i}" for i in range(400)), "", "a short one", " ".join(f"term{i}" for i in range(90))])
    ranks = fingerprint.level_ranks(fingerprint.level_histogram(raw))
    together = fingerprint.digests(raw, ranks)
    assert together == [fingerprint.digests([t], ranks)[0] for t in raw] and together[0] == together[4] and together[3] == ""
    assert fingerprint.likeness(together, together) == [1.0] * 6 and fingerprint.likeness(["", together[2]], [together[2], ""]) == [0, 0]


def test_neighbours_equal_brute_force(spark, sf_dir, no_docs):
    docs = table(spark, sf_dir, "documents")
    got = {r.doc_id: r for r in fingerprint.neighbours(docs).collect()}
    rows = docs.orderBy(F.desc("doc_id")).collect()
    for r, after in zip(rows, [*rows[1:], rows[0]], strict=True):
        cut = len(r.text) // 3
        edited = r.text[: len(r.text) - cut] + after.text[:cut]
        assert got[r.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[r.doc_id].n_chars == len(r.text)
    near = np.array([(g.near_edited, g.near_next) for g in got.values()])
    assert near[:, 0].mean() > 0.5 > 0.2 > near[:, 1].mean()
    assert fingerprint.neighbours(no_docs).count() == 0


def test_neighbours_of_odd_rows(odd_docs):
    out = fingerprint.neighbours(odd_docs).collect()
    assert len(out) == odd_docs.count() and len({r.fingerprint for r in out if r.doc_id == 1}) == 1


# --- near copies


def five(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def plain_classes(rows):
    """Smallest doc_id of each class, from all pairs that share a shingle."""
    sets = {r.doc_id: five(r.text) for r in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and common >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}


def test_classes_equal_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = plain_classes(docs.collect())
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()} == want
    assert sorted(r.doc_id for r in near_dup.deduplicated(docs).collect()) == sorted(set(want.values()))


def test_groups_of_near_copies_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):  # between 0 and 4 words changed: links of all strengths
        text = base.copy()
        for at in rng.integers(0, 80, int(rng.integers(0, 5))):
            text[at] = f"x{rng.integers(40)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()} == plain_classes(docs.collect())


def test_texts_with_repeated_blocks_are_classed(spark):
    texts = []
    for k in range(40):
        block = [f"b{k}w{i}" for i in range(60)]
        texts += [" ".join(block), " ".join(block * 2), " ".join(block * 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    plain = plain_classes(docs.collect())
    assert got == plain and set(plain.values()) == set(range(0, 120, 3))


def test_dart_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(6)
    a, b = rng.uniform(0, 3, 300), rng.uniform(0, 3, 300)
    b[:200] = a[:200]
    element = rng.integers(0, 2**63, 300).astype(np.uint64)
    sign = near_dup.dart_signatures(np.concatenate([element, element]), np.concatenate([a, b]), np.repeat([0, 1], 300), 2, 2048)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sign[0] == sign[1]).mean() - want) < 0.05 and (sign > 0).all()


def test_near_copies_of_odd_rows(odd_docs, no_docs):
    got = near_dup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r.class_id for r in got if r.doc_id in (5, 6)} == {5} and {r.class_id for r in got if r.doc_id in (2, 3, 4)} == {2}
    kept = near_dup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "7", "8", "None"]
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (200, 200)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((90, 95, 100), 90)}


# --- contamination


def test_hits_equal_brute_force(spark, odd_docs, no_docs):
    items = [("i1", " ".join(f"w{i}" for i in range(100, 120))), ("i2", "four FIVE"), ("i3", None), ("i4", "!!"), ("i10", "four five"), ("i5", "漢字 S")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for most in (10, 10**6):
        for r in contamination.contamination(odd_docs, bench, most_chars=most).collect():
            own = plain_words((r.text or "").encode())
            hit, found = set(), set()
            for name, text in items:
                for win in contamination.item_windows(plain_words((text or "").encode())):
                    w = win.split()
                    for at in range(len(own) - len(w) + 1):
                        if own[at : at + len(w)] == w:
                            hit |= set(range(at, at + len(w)))
                            found.add(name)
            assert (r.n_words, list(r.hit_words), list(r["items"])) == (len(own), sorted(hit), sorted(found))
            if r.doc_id == 1:
                assert [(s.start, s.end) for s in r.hit_spans] == [(14, 23)]
    clean = contamination.decontaminated(odd_docs, bench)
    assert clean.columns == odd_docs.columns and {r.doc_id for r in clean.collect()} == {2, 3, 4, 5, 6, 8, None}
    assert contamination.decontaminated(odd_docs, bench.limit(0)).count() == odd_docs.count()
    assert contamination.contamination(no_docs, bench).count() == 0


def test_items_without_id_hit_words(spark):
    passage = " ".join(f"b{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"a {passage} z"), (2, "clean words")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage)], "item_id string, text string")
    found = {r.doc_id: r for r in contamination.contamination(docs, items).collect()}
    assert found[1].hit_words == list(range(1, 16)) and found[1].items == [] and len(found[1].hit_spans) == 1 and found[2].hit_words == []
    assert [r.doc_id for r in contamination.decontaminated(docs, items).collect()] == [2]


# --- passages


def test_chain_is_the_best_chain():
    rng = np.random.default_rng(7)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        x, y = rng.integers(0, 60, n), rng.integers(0, 60, n)

        def worth(c):
            return 6 * len(c) - 0.05 * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(c, c[1:]))

        best = max(
            worth(c) for size in range(1, n + 1) for c in itertools.permutations(range(n), size)
            if size < 5 and all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:])) or size == 1
        )
        got = passages.chains(x, y)
        assert sorted(i for c in got for i in c) == list(range(n))
        assert worth(got[0]) >= best - 1e-9


def test_passages_found_where_planted(spark):
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(60)]
    rows, exact, fuzzy = [], set(range(0, 40, 4)), set(range(1, 40, 8))
    for i in range(60):
        text = [f"d{i}n{k}" for k in range(int(rng.integers(30, 120)))]
        own = passage.copy()
        if i in fuzzy:
            for at in rng.integers(5, 55, 2):
                own[at] = f"e{i}"
        if i in exact | fuzzy:
            at = int(rng.integers(0, len(text)))
            text = text[:at] + own + text[at:]
        rows.append((i, " ".join(text)))
    rows.append((60, " ".join(passage[:40] + ["q"] * 30)))  # too short a piece
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == exact | fuzzy
    texts = {i: words(t) for i, t in rows}
    for r in found:
        a, b = texts[r.doc_id][r.start : r.end], texts[r.other_doc_id][r.other_start : r.other_end]
        assert len(a) == len(b) == 60 and sum(p == q for p, q in zip(a, b, strict=True)) == r.n_equal


def test_two_passages_of_one_pair_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    p, q, lone = ([f"{name}{i}" for i in range(n)] for name, n in (("p", 60), ("q", 60), ("z", 6)))
    fill = lambda n: [f"f{k}" for k in rng.integers(0, 10**9, n)]
    pairs = [(p + fill(n) + q, p + fill(m) + q) for n, m in ((50, 0), (50, 50), (100, 100), (200, 200), (20, 20), (0, 300))]
    pairs += [(p[:50] + fill(n) + lone, p[:50] + fill(n) + lone) for n in (5, 20, 55)] + [(lone + fill(30) + p, lone + fill(200) + p)]
    noisy = [w if rng.random() > 0.1 else "x" for w in p + q]
    pairs.append((fill(40) + p + fill(35) + q, fill(10) + noisy[:60] + fill(35) + noisy[60:]))
    texts = [[f"t{k}"] + t for k, pair in enumerate(pairs) for t in pair]
    # words differ from pair to pair
    texts = [[f"{w}v{k // 2}" for w in t] for k, t in enumerate(texts)]
    found = passages.repeated_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert all(r.doc_id // 2 == r.other_doc_id // 2 for r in found)
    for k in range(0, len(texts), 2):
        a, b = texts[k], texts[k + 1]
        same = [(i, b.index(w)) for i, w in enumerate(a) if w in b and not w.startswith("xv")]
        assert same == sorted(same, key=lambda s: s[1])
        wanted = set()
        for u, v in itertools.combinations(range(len(same)), 2):
            sides = [same[v][c] - same[u][c] + 1 for c in (0, 1)]
            if min(sides) >= 50 and v - u + 1 >= 0.8 * max(sides):
                wanted |= {same[w][0] for w in range(u, v + 1)}
        got = [r for r in found if r.doc_id == k]
        assert wanted == {i for r in got for i, _ in same if r.start <= i < r.end}, k
        assert all(min(r.end - r.start, r.other_end - r.other_start) >= 50 for r in got)
        for r in got:
            assert r.n_equal == sum(r.start <= i < r.end and r.other_start <= j < r.other_end for i, j in same)
            assert r.n_equal >= 0.8 * max(r.end - r.start, r.other_end - r.other_start)


def test_passages_of_frequent_parts_are_linked(spark):
    rng = np.random.default_rng(11)
    fill = lambda n: [f"f{k}" for k in rng.integers(0, 10**9, n)]
    lines = [[f"l{k}w{i}" for i in range(20)] for k in range(4)]
    # every two lines that follow each other stand in many texts, less than a passage each; all four in three texts
    rows = [(i, fill(40) + lines[i % 3] + lines[i % 3 + 1] + fill(40)) for i in range(240)]
    rows += [(i, fill(30) + sum(lines, []) + fill(30)) for i in (300, 301, 302)]
    found = passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {300, 301, 302}
    assert {(r.start, r.end, r.other_start, r.other_end, r.n_equal) for r in found} == {(30, 110, 30, 110, 80)}


def test_windows_of_frequent_seeds():
    rng = np.random.default_rng(12)
    for _ in range(200):
        text = [b" ".join(b"%d" % w for w in rng.integers(0, 10**6, 150))]
        _, _, places = passages.seeds(text)
        more = rng.random(len(places)) < 0.9
        begins, ends = passages._frequent_spans(places, more.astype(int))
        got = {s for b, e in zip(begins, ends, strict=True) for s in range(b, e)}
        for s in range(101):
            inside = (places - 11 >= s) & (places + 17 <= s + 50)
            assert (s in got) == bool(more[inside].all())


def test_seeds_of_many_words_and_slices(monkeypatch):
    rng = np.random.default_rng(13)
    n = (1 << 24) + 1000
    letters = np.full(2 * n, ord(" "), np.uint8)
    letters[::2] = rng.integers(ord("a"), ord("z") + 1, n)
    hashes, owners, places = passages.seeds([letters.tobytes()])
    assert places.max() >= n - 17 and not owners.any() and (np.diff(places) <= 12).all()
    tail, _, at = passages.seeds([letters[2 * (n - 5000) :].tobytes()])
    assert (tail == hashes[-len(tail) :]).all() and (at + n - 5000 == places[-len(at) :]).all()
    raw = [" ".join(map(str, rng.integers(0, 50, size))).encode() for size in rng.integers(0, 300, 60)]
    whole = passages.seeds(raw)
    monkeypatch.setattr(passages, "SLICE_BYTES", 1000)
    monkeypatch.setattr(passages, "SLICE_WORDS", 37)
    assert all((a == b).all() for a, b in zip(whole, passages.seeds(raw), strict=True))


def test_long_gaps_are_aligned_from_both_ends():
    rng = np.random.default_rng(10)
    a = [str(w) for w in rng.integers(0, 10**9, 400)]
    b = [w if k % 6 else "x" for k, w in enumerate(a)]
    b[200:200] = [f"n{k}" for k in range(150)]
    runs = passages.align(["s"] * 6 + a + ["e"] * 6, ["s"] * 6 + b + ["e"] * 6, [0, 406], [0, 556])
    # 333 words agree besides the anchors, before and behind the 150 words that only b has; some next to these may stay out
    assert 333 + 12 - 8 <= runs[:, 2].sum() <= 333 + 12
    (s, e, *_), (t, f, *_) = passages.passages_of(runs)
    assert s == 0 and 200 <= e <= 206 <= t <= 212 and f == 412


def test_passages_of_odd_rows(odd_docs, no_docs):
    found = passages.repeated_passages(odd_docs).collect()
    assert {(r.doc_id, r.other_doc_id) for r in found} == {(5, 6), (6, 5)} and all(r.end - r.start == 3000 for r in found)
    assert passages.repeated_passages(no_docs).count() == 0


# --- words


def test_words_are_the_contract_words():
    text = "A-Z é1_x [^] Ünï漢字 \x7f~"
    assert [w.decode() for w in plain_words(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_finished_shuffles_of_passages_are_deleted(spark, monkeypatch):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left = []

    def held(of):
        before = manager.getAllFiles().size()
        release(of)
        end = time.time() + 20
        while manager.getAllFiles().size() >= before and time.time() < end:
            time.sleep(0.2)
        left.append((before, manager.getAllFiles().size()))

    monkeypatch.setattr(passages, "release", held)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(["a1", *words])), (2, " ".join(["b1", *words]))], "doc_id long, text string")
    assert {(r["doc_id"], r["n_equal"]) for r in passages.repeated_passages(docs).collect()} == {(1, 60), (2, 60)}
    assert len(left) == 2 and left[0][1] < left[0][0]
