from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import numpy as np
import pytest

from mailsift.llm import packing, secrets
from mailsift.llm.common import staged

from .conftest import SF
from .test_mixing import plain_targets, words
from .test_neardup import plain_components
from .test_packing import plain_ids


@pytest.fixture(scope="module")
def steps(spark, sf_docs):
    """The input and what every stage returns, each written and read again."""
    docs, out = sf_docs[0], [sf_docs[0]]
    for _, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def test_language_keeps_documents_with_a_language(steps):
    before, after = ({r.doc_id: r for r in s.collect()} for s in steps[:2])
    gone = [r for i, r in before.items() if i not in after]
    assert all(after[i] == before[i] for i in after)
    assert not [r for r in gone if any(c.isalpha() for c in r.text or "")]


def test_one_of_each_group_of_near_duplicates_stays(steps):
    before = {r.doc_id: r.text for r in steps[1].collect()}
    roots, _ = plain_components(before, 5)
    assert {r.doc_id for r in steps[2].collect()} == set(roots.values())


def test_live_secrets_go_and_everything_else_stays(steps):
    before, after = ({r.doc_id: r for r in s.collect()} for s in steps[2:4])
    assert set(before) == set(after)
    hidden = 0
    spans = {r.doc.doc_id: [s for s in r.spans if s.live] for r in secrets.scan(steps[2]).collect()}
    for i, row in after.items():
        text, at, out = before[i].text, 0, []
        for s in spans[i]:
            if s.start >= at:
                out += [text[at : s.start], secrets.PLACEHOLDER]
                hidden += 1
            at = max(at, s.end)
        assert row.text == "".join([*out, text[at:]])
        assert not out or row.n_chars == len(row.text)
    assert hidden == sum(len(s) > 0 for s in spans.values()) or hidden > 0


def test_sources_are_mixed_by_targets(steps):
    before, after = steps[3].collect(), steps[4].collect()
    assert set(after) <= set(before)
    assert max(Counter(r.doc_id for r in after).values()) <= 3
    size, taken, largest = (defaultdict(int) for _ in range(3))
    for r in before:
        size[r.source] += words(r.text)
        largest[r.source] = max(largest[r.source], words(r.text))
    for r in after:
        taken[r.source] += words(r.text)
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    for s, target in zip(names, plain_targets([size[n] for n in names])):
        assert abs(taken[s] - target) <= largest[s]


def test_all_tokens_are_packed(steps):
    pieces = steps[5].collect()
    want = Counter()
    for r in steps[4].collect():
        want.update(plain_ids(r.text))
    got = Counter()
    filled = Counter()
    for p in pieces:
        got.update(np.frombuffer(bytes(p.ids), "<u4").tolist())
        filled[p.sequence_id] += p.length
    assert got == want and max(filled.values()) <= packing.CAPACITY


def test_run_is_all_stages(spark, steps):
    key = lambda r: (r.doc_id, r.start, bytes(r.ids))
    got = sorted(key(r) for r in pipeline.run(spark, SF).collect())
    assert got == sorted(key(r) for r in steps[5].collect())


def test_odd_rows(spark, odd_documents, documents):
    for docs, rows in ((odd_documents, 10), (documents([]), 0)):
        columns = docs.columns
        for name, stage in pipeline.STAGES[:-1]:
            docs = staged(stage(spark, docs, SF), "test-odd")
            assert docs.columns == columns, name
            assert docs.count() <= 3 * rows
        assert pipeline.STAGES[-1][1](spark, docs, SF).count() >= 0


def test_without_labels_documents_with_letters_stay(spark, documents):
    rows = [{"doc_id": i, "text": f"Clean text number {i}.", "source": "a"} for i in range(20)]
    docs = documents([*rows, {"doc_id": 20, "text": "123 !?"}, {"doc_id": 21, "text": None}, {"doc_id": 22, "text": ""}])
    assert sorted(r.doc_id for r in pipeline.identify_language(spark, docs, SF).collect()) == list(range(20))


def test_rows_of_one_id_and_without_id_are_compared(spark, documents):
    text = "one two three four five six seven eight nine ten"
    rows = [{"doc_id": 3, "text": text}] * 3 + [{"doc_id": None, "text": text}, {"doc_id": 2, "text": "other words " + text[::-1]}]
    rows += [{"doc_id": None, "text": "a text of its own, without any id"}] * 2 + [{"doc_id": 9, "text": None}, {"doc_id": 9, "text": ""}]
    kept = pipeline.drop_near_duplicates(spark, documents(rows), SF)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    want = [(2, rows[4]["text"]), (3, text), (9, ""), (9, None), (None, rows[5]["text"])]
    assert got == sorted(want, key=repr)


def test_of_equal_texts_the_smallest_id_stays(spark, documents):
    text = "one two three four five six seven eight nine ten"
    rows = [{"doc_id": i, "text": text} for i in (8, 4, 6)] + [{"doc_id": None, "text": text}]
    assert [r.doc_id for r in pipeline.drop_near_duplicates(spark, documents(rows), SF).collect()] == [4]
