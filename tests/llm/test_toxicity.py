from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from mailsift.llm import toxicity

LEXICON = {"clown": 2.0, "scum": 3.0}


def found(text):
    return {(toxicity.PATTERNS[p], w) for p, w in toxicity.clause_patterns(toxicity.words(text), LEXICON)}


def test_patterns_of_clauses():
    assert found("what a clown") == {("plain", "clown")}
    assert found("you are a clown") == {("aimed", "clown")}
    assert found("a clown is what you are") == {("aimed", "clown")}
    assert found("he is not a clown") == {("denied", "clown")}
    assert found("not in all of these years a clown") == {("plain", "clown")}
    assert found("they said that he is a clown") == {("told", "clown")}
    assert found("i will hurt you") == {("threat", "you")}
    assert found("i will not hurt you") == set()
    assert found("they beat the drum") == set()
    assert found("you scum and clown") == {("aimed", "scum"), ("aimed", "clown")}


def test_composed_machine_equals_its_parts():
    parts = [toxicity.negation(), toxicity.reported(), toxicity.threats(), toxicity.targets(), toxicity.insults()]
    following, written = toxicity.GRAMMAR
    for symbols in itertools.product(toxicity.SYMBOLS, repeat=5):
        stream = list(symbols)
        for part in parts:
            state, out = 0, []
            for s in stream:
                state, s = part.step(state, s)
                out.append(s)
            stream = out
        state, got = 0, []
        for s in symbols:
            got.append(written[state][s])
            state = following[state][s]
        assert got == [toxicity.PATTERNS.index(s) if s in toxicity.PATTERNS else -1 for s in stream]


def test_evidence_counts_a_word_once_per_pattern():
    x, clauses = toxicity.evidence("A clown. Clown! You clown; not a scum\nclown", LEXICON)
    assert x[:5].tolist() == [2.0, 2.0, 3.0, 0.0, 0.0] and clauses == 5
    assert toxicity.evidence(None, LEXICON)[0].tolist() == [0.0] * 6


def test_fit_moves_from_its_prior_to_the_labels():
    rng = np.random.default_rng(1)
    x = rng.random((400, 6)) * 4
    y = (x[:, 0] + x[:, 1] > 4).astype(float)
    w = toxicity.fitted(x, y)
    assert (((w[0] + x @ w[1:]) > 0) == y).mean() > 0.95
    assert np.allclose(toxicity.fitted(np.zeros((0, 6)), np.zeros(0)), toxicity.PRIOR)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, labels)
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 500
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.98
    assert np.mean([r["predicted"] for r in rows if r["toxic"]]) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, toxic int, score string")


def test_odd_rows(odd_documents, labels):
    scored = toxicity.score(odd_documents, labels([(1, 0), (2, None), (5, 1), (5, 0), (7, 1), (None, 1), (99, 1), (6, 3)]))
    assert scored.columns == ["doc_id", "held_out", "score", "predicted", "clauses"]
    rows = scored.collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[1] == by_id[2] == by_id[3]


def test_empty_tables(spark, documents, labels):
    assert toxicity.score(documents([]), labels([])).collect() == []
    only = toxicity.score(documents([{"doc_id": 1, "text": "I will kill you."}, {"doc_id": 2, "text": "x"}]), labels([])).collect()
    scores = {r["doc_id"]: r["score"] for r in only}
    assert scores[1] > scores[2]


def test_a_rerun_gives_the_same_scores(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    once = sorted(tuple(r) for r in toxicity.score(docs, labels).collect())
    again = sorted(tuple(r) for r in toxicity.score(docs.repartition(5), labels.repartition(3)).collect())
    assert once == again
