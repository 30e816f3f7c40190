from __future__ import annotations

import random

import numpy as np
import pytest

from mailsift.llm import graphs, neardup


def plain_set(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain_components(docs, width, likeness=80):
    """Smallest reachable id of every id, from all pairs."""
    sets = {i: plain_set(t, width) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    seen = set()
    for group in holders.values():
        for n, a in enumerate(group):
            for b in group[n + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= likeness * len(sets[a] | sets[b]):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(sets[i]) for i in ids}


def copies(seed, base, n, edits):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("width", [4, 5])
def test_equals_brute_force_on_documents(sf_docs, width):
    df, rows = sf_docs
    want, sizes = plain_components({r.doc_id: r.text for r in rows}, width)
    got = neardup.near_duplicates(df, width).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_groups_of_near_copies(documents):
    r = random.Random(3)
    texts = []
    for g in range(6):
        base = [f"w{r.randrange(5000)}" for _ in range(120)]
        texts += copies(g, base, 60, 5)
    texts += copies(9, [f"v{i}" for i in range(60)], 40, 9)
    r.shuffle(texts)
    docs = dict(enumerate(texts))
    want, _ = plain_components(docs, 4)
    got = neardup.near_duplicates(documents([{"doc_id": i, "text": t} for i, t in docs.items()]), 4).collect()
    assert {x.doc_id: x.component_id for x in got} == want


def test_borders_of_partitions_lose_no_pair(documents, monkeypatch):
    monkeypatch.setattr(neardup, "TASK_ROWS", 200)
    texts = [t for g in range(30) for t in copies(g, [f"w{g}x{i}" for i in range(80)], 2, 1)]
    got = neardup.near_duplicates(documents([{"doc_id": i, "text": t} for i, t in enumerate(texts)]), 4).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: i - i % 2 for i in range(60)}


@pytest.mark.parametrize("block", [7, 1024])
def test_dense_regions_lose_no_link(documents, monkeypatch, block):
    """Many texts that are alike but not linked, and links between a few of them; the window sees little."""
    monkeypatch.setattr(neardup, "WINDOW", 1)
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(60):
        words = list(base)
        for k in r.sample(range(0, 150, 5), r.randint(1, 7)):
            words[k] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = dict(enumerate(texts))
    want, _ = plain_components(docs, 4)
    assert 3 < len(set(want.values())) < 58
    got = neardup.near_duplicates(documents([{"doc_id": i, "text": t} for i, t in docs.items()]), 4).collect()
    assert {x.doc_id: x.component_id for x in got} == want


def test_components(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(1, 60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(30)]
    got = {x.node: x.root for x in graphs.components(spark.createDataFrame(links, "x long, y long")).collect()}
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in root}


def test_signatures_estimate_likeness():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(101, 1101, dtype=np.uint64)
    mixed = [x * np.uint64(0x9E3779B97F4A7C15) ^ (x << np.uint64(7)) for x in (a, b)]
    labels = [np.frombuffer(neardup.signature(x).astype(">i8").tobytes(), ">u2") for x in mixed]
    assert abs(np.mean(labels[0] == labels[1]) - 900 / 1100) < 0.1


def test_odd_rows(odd_documents, documents):
    got = {r.doc_id: r for r in neardup.near_duplicates(odd_documents).collect()}
    assert neardup.near_duplicates(odd_documents).count() == 10
    assert [got[i].n_shingles for i in (1, 2, 3)] == [0, 0, 0]
    assert [got[i].component_id for i in (1, 2, 3, 5, 6, 7)] == [1, 2, 3, 5, 5, 7]
    assert got[None].component_id is None and got[None].kept
    assert neardup.near_duplicates(documents([])).collect() == []


def test_an_id_with_two_texts_is_one_node(documents):
    rows = [(5, "alpha beta gamma delta"), (5, "one two three four"), (2, "one two three four"), (9, "alpha beta gamma delta")]
    got = neardup.near_duplicates(documents([{"doc_id": i, "text": t} for i, t in rows])).collect()
    assert {r.component_id for r in got} == {2}
