from __future__ import annotations

import zlib

import numpy as np

from mailsift.llm import language


def test_held_out_accuracy(sf_docs):
    df, rows = sf_docs
    found = {r.doc_id: r for r in language.train_and_identify(df).collect()}
    assert len(found) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and all(found[r.doc_id].held_out for r in held)
    assert np.mean([found[r.doc_id].lang_pred == r.lang for r in held]) > 0.95


def test_counts_equal_plain_python(documents):
    docs = [("aa b", "x"), ("ab ab", "x"), ("cd", "y")]
    model = language.train(documents([{"text": t, "lang": g} for t, g in docs]))
    assert model.languages == ("x", "y")
    table = np.full((language.FEATURES, 2), language.SMOOTHING)
    for text, lang in docs:
        for bucket in language.features([text])[0]:
            table[bucket, "xy".index(lang)] += 1
    assert np.allclose(model.log_prob, np.log(table / table.sum(axis=0)), atol=1e-5)
    assert np.allclose(np.exp(model.log_prior), [2 / 3, 1 / 3])


def test_batches_do_not_change_features():
    texts = ["ein haus", "", "a", "12 x 34"]
    together = language.features(texts)
    for i, text in enumerate(texts):
        alone = language.features([text])
        assert sorted(together[0][together[1] == i]) == sorted(alone[0])
        assert together[2][i] == alone[2][0]


def test_odd_rows(odd_documents):
    found = language.train_and_identify(odd_documents).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 10
    for i in (1, 2, 3, 1 << 40):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[5].lang_pred == by_id[6].lang_pred and 0 < by_id[5].score <= 1
    assert by_id[None].held_out is False


def test_nothing_to_learn_from(documents):
    for rows in ([], [{"doc_id": 1, "text": "some words", "lang": None}]):
        found = language.train_and_identify(documents(rows)).collect()
        assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)] * len(rows)
