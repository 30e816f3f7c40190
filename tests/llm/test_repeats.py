from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from mailsift.llm import repeats

N = repeats.LENGTH


def plain(texts):
    """(n_bytes, n_removed, n_spans, sha256) per text, from a count of all strings."""
    data = [(t or "").encode() for t in texts]
    counts = {}
    for d in data:
        for i in range(len(d) - N + 1):
            s = d[i : i + N]
            counts[s] = counts.get(s, 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - N + 1):
            if counts[d[i : i + N]] > 1:
                gone[i + 1 : i + 1 + N] = True
        kept = bytes(b for b, g in zip(d, gone[1:]) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(documents, texts):
    df = documents([{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    rows = repeats.digest(repeats.remove_repeats(df)).collect()
    got = {r.doc_id: tuple(r)[1:5] for r in rows}
    assert len(rows) == len(texts)
    assert got == dict(enumerate(plain(texts)))
    check_shared(texts, {r.doc_id: r.n_shared for r in rows})


def check_shared(texts, found):
    """Documents with a common string of 320 bytes are told; those without one of 128 are not."""
    holders = {}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        for width in (repeats.PASSAGE, repeats.REACH + repeats.PASSAGE):
            for at in range(len(data) - width + 1):
                holders.setdefault(data[at : at + width], set()).add(i)
    short = {i for s, h in holders.items() if len(h) > 1 and len(s) == repeats.PASSAGE for i in h}
    long = {i for s, h in holders.items() if len(h) > 1 and len(s) > repeats.PASSAGE for i in h}
    told = {i for i, n in found.items() if n > 0}
    assert long <= told <= short


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))


def passages(seed):
    """Texts that share passages of many lengths, with edits, at all places."""
    r = random.Random(seed)
    pool = [prose(r, n) for n in (70, 85, 90, 100, 150, 300)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            if r.random() < 0.6:
                p = r.choice(pool)
                a, b = sorted((r.randrange(len(p)), r.randrange(len(p))))
                parts.append(p if r.random() < 0.3 else p[:b] if r.random() < 0.5 else p[a:])
            else:
                parts.append(prose(r, r.randint(1, 120)))
        texts.append("".join(parts) if r.random() < 0.5 else " ".join(parts))
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(documents, seed):
    check(documents, passages(seed))


def test_large_dictionaries_are_split(documents, monkeypatch):
    # Small parts take the ways of hot passages: blocks first, then single strings.
    monkeypatch.setattr(repeats, "PIECE", 500)
    monkeypatch.setattr(repeats.dictionary_ranges, "__defaults__", (3,))
    r = random.Random(8)
    passage = prose(r, 110)
    texts = [prose(r, 30) + passage[: r.choice([410, 430, len(passage)])] + prose(r, 30) for _ in range(25)]
    check(documents, [*passages(4)[:25], *texts])


def test_low_complexity_and_borders(documents):
    a = "a" * 900
    texts = [a, "b" * (N - 1), "c" * N, "d" * (N + 1), "ab" * 450, "é" * 300, "x" * N + "y" * N, None, "", "z" * 100]
    r = random.Random(6)
    edge = prose(r, 200)
    texts += [edge[:N], edge[1 : N + 1], edge[: N - 1], edge[500 : 500 + N], edge]
    check(documents, texts)


def test_equals_brute_force_on_documents(documents, sf_docs):
    _, rows = sf_docs
    check(documents, [r.text for r in rows])


def test_triggers_depend_on_the_string_alone():
    r = random.Random(2)
    text = (prose(r, 400) + "q" * 700 + prose(r, 100)).encode()
    whole = {p: at for at, first, last in repeats.triggers(text) for p in range(first, last + 1)}
    assert sorted(whole) == list(range(len(text) - repeats.DECIDED + 1))
    for p in range(0, len(text) - repeats.DECIDED, 37):
        ((at, first, last),) = repeats.triggers(text[p : p + repeats.DECIDED])
        assert (first, last) == (0, 0) and at + p == whole[p]
        assert 0 <= at < repeats.REACH


def test_a_short_passage_is_told_but_stays(documents):
    r = random.Random(9)
    passage = prose(r, 56)[:330]
    texts = [prose(r, 40) + passage + prose(r, 3), passage, prose(r, 90), prose(r, 20) + " " + passage]
    check(documents, texts)
    rows = repeats.digest(repeats.remove_repeats(documents([{"doc_id": i, "text": t} for i, t in enumerate(texts)]))).collect()
    assert {r.doc_id: (r.n_removed, r.n_shared > 0) for r in rows} == {0: (0, True), 1: (0, True), 2: (0, False), 3: (0, True)}


def test_odd_rows(odd_documents, documents):
    rows = repeats.digest(repeats.remove_repeats(odd_documents)).collect()
    assert len(rows) == 10
    assert all(r.n_removed == 0 for r in rows if r.doc_id not in (4,))
    twice = odd_documents.filter("doc_id = 4").unionAll(odd_documents.filter("doc_id = 4"))
    assert [r.n_removed == r.n_bytes > 0 for r in repeats.digest(repeats.remove_repeats(twice)).collect()] == [True, True]
    assert repeats.remove_repeats(documents([])).collect() == []
