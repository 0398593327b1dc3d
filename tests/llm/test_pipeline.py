"""Each stage of the pipeline against a plain version, on what the stage before kept."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from commitlore.llm import contamination, mixing
from commitlore.llm.common import plain_words, table
from commitlore.session import stage
from tests.llm.test_operators import plain_classes


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = [docs]
    for _, step in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(step(spark, kept[-1], sf_dir)))
        assert kept[-1].columns == docs.columns
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in kept]
    assert ids[1] == [r.doc_id for r in docs.orderBy("doc_id").collect() if re.search(r"[^\W\d_]", r.text or "")]
    assert ids[2] == sorted(set(plain_classes(kept[1].collect()).values()))
    windows = [w.split() for r in table(spark, sf_dir, "benchmark").collect() for w in contamination.item_windows(plain_words(r.text.encode()))]
    by_first: dict = {}
    for w in windows:
        by_first.setdefault(w[0], []).append(w)
    clean = []
    for r in kept[2].collect():
        own, hit = plain_words(r.text.encode()), set()
        for at, word in enumerate(own):
            for w in by_first.get(word, ()):
                if own[at : at + len(w)] == w:
                    hit |= set(range(at, at + len(w)))
        if not hit or 20 * len(hit) < len(own):
            clean.append(r.doc_id)
    assert ids[3] == sorted(clean)
    plan = mixing.mix_plan(kept[3]).agg(F.sum("taken")).first()[0]
    assert plan == kept[4].agg(F.sum(mixing.word_count("text"))).first()[0]
    rows = corpus_pipeline.STAGES[-1][1](spark, kept[4], sf_dir).collect()
    assert {d for r in rows for d in r.doc_ids} == set(ids[4]) and all(r.n_tokens == r.cu_seqlens[-1] for r in rows)
