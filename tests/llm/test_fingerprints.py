from __future__ import annotations

import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailsift.llm import fingerprints


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaves(text):
    return re.findall(r"[^.!?\n]{0,100}+[.!?\n]++[ \t]*+|[^.!?\n]{1,100}+", text)


def tree(text):
    sections = [s for s in re.split(r"(?<=\n\n)(?!\n)", text) if s]
    paragraphs = [[p for p in re.split(r"(?<=\n)(?!\n)", s) if p] for s in sections]
    return sha("r" + "".join(sha("s" + "".join(sha("p" + "".join(map(sha, leaves(p)))) for p in s)) for s in paragraphs))


def like(a, b):
    x, y = set(leaves(a)), set(leaves(b))
    size = lambda s: sum(min(len(v), 255) for v in s)
    return 2 * size(x & y) / (size(x) + size(y)) if x or y else 1.0


def expected(docs):
    order = sorted(docs, key=lambda d: (d[0], (d[1] or "").encode()))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out.append(
            (doc_id, len(text), sha(edited), tree(text), tree(edited), round(like(text, edited), 9), round(like(text, following), 9))
        )
    return out


def got(df):
    rows = fingerprints.compare(df).collect()
    return sorted((*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)


def test_equals_plain_python(sf_docs):
    df, rows = sf_docs
    assert got(df) == sorted(expected([(r.doc_id, r.text) for r in rows]))


def test_scattered_ids_and_odd_texts(documents):
    ids = [-(1 << 62), -5, -1, 0, 1, 1023, 1024, 5000, 1 << 33, (1 << 33) + 1, (1 << 62) + 3]
    texts = ["A b. C d!\n\nNew section\nline two", "", None, "é\U0001f600x" * 70, "same", "same", "\n\n\n", "x." * 300, "w" * 1001, "Q? R.", "end"]
    docs = list(zip(ids, texts))
    assert got(documents([{"doc_id": i, "text": t} for i, t in docs])) == sorted(expected(docs))


def test_leaves_make_up_the_text(value):
    for text in ["A. b! c?? \n\n d", "x" * 350 + ".\n" + "y" * 99 + "!!", "...", "é" * 205]:
        found = value(F.regexp_extract_all(F.lit(text), F.lit(fingerprints.LEAF), F.lit(0)))
        assert "".join(found) == text and found == leaves(text)


def test_differing_branches_are_located(value):
    a, b = "One.\nTwo.\n\nThree.\nFour.", "One.\nTwo.\n\nThree.\nFive.\nSix."
    trees = [fingerprints.paragraph_hashes(F.lit(t)) for t in (a, b)]
    assert [tuple(x) for x in value(fingerprints.differing(*trees))] == [(1, 1), (1, 2)]
    assert value(fingerprints.differing(trees[0], trees[0])) == []


def test_what_is_put_in_shifts_nothing(value):
    def places(a, b):
        trees = [fingerprints.paragraph_hashes(F.lit(t)) for t in (a, b)]
        return [tuple(x) for x in value(fingerprints.differing(*trees))]

    thirty = "Equal line.\n" * 30
    assert places(thirty, "New.\n" + thirty) == [(0, 0)] and places("New.\n" + thirty, thirty) == []
    assert places(thirty, "Equal line.\n" + thirty) == [(0, 30)]
    sections = "".join(f"Head {i}.\nBody {i}.\n\n" for i in range(6))
    assert places(sections, "A.\n\n" + sections.replace("Body 4", "Corpse 4")) == [(0, 0), (5, 1)]
    assert places("a\nb\nc\n", "b\na\nc\n") == [(0, 1)]
    assert places("", "") == [] and places("", "x") == [(0, 0)] and places("x", "") == []


@given(st.lists(st.sampled_from(["a\n", "b\n", "c\n\n", "d"]), max_size=12), st.lists(st.sampled_from(["a\n", "b\n", "c\n\n", "d"]), max_size=12))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_differences_in_both_directions_explain_the_edit(value, x, y):
    a, b = "".join(x), "".join(y)
    trees = [fingerprints.paragraph_hashes(F.lit(t)) for t in (a, b)]

    def left(text, places):
        parts = [[p for p in re.split(r"(?<=\n)(?!\n)", s) if p] for s in re.split(r"(?<=\n\n)(?!\n)", text) if s]
        return [p for i, s in enumerate(parts) for j, p in enumerate(s) if (i, j) not in places]

    new, old = ({tuple(p) for p in value(fingerprints.differing(*t))} for t in (trees, trees[::-1]))
    assert (a == b) == (not new and not old)
    assert is_part(left(b, new), left(a, set())) and is_part(left(a, old), left(b, set()))


def is_part(some, whole):
    """Whether a list comes out of another by leaving out."""
    rest = iter(whole)
    return all(p in rest for p in some)


def test_documents_without_ids_are_their_own_next(documents):
    rows = fingerprints.compare(documents([{"doc_id": None, "text": f"No id {i}. At all."} for i in range(5)])).collect()
    assert len(rows) == 5 and all(r.near_next == 1.0 for r in rows)


def test_odd_rows(odd_documents, documents):
    rows = fingerprints.compare(odd_documents).collect()
    assert len(rows) == 10
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5].fingerprint == by_id[6].fingerprint and by_id[5].near_next == 1.0
    assert by_id[1].n_chars == 0 and by_id[1].fingerprint == by_id[2].fingerprint == tree("")
    assert fingerprints.compare(documents([])).collect() == []
    assert got(documents([{"doc_id": 3, "text": "alone. here"}])) == expected([(3, "alone. here")])
