from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import pytest

from mailsift.llm import lexical

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(SMALL))


def plain(docs, items):
    """Lists of (score, doc_id) per item, in the order of the items."""
    counts = [(d, Counter(words(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    total = sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in counts:
            m = 25 + 75 * n * len(counts) // total
            score = 0
            for t, q in Counter(words(text)).items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1)))
                    score += q * w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        found.sort()
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(found[: lexical.TOP])]
    return out


@pytest.fixture
def tables(spark):
    def build(docs, items):
        return (
            spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item long, score string"),
            spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, rank long, terms string"),
        )

    return build


def check(found, docs, items):
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == sorted(plain(docs, items), key=repr)


def test_terms():
    text = "It's A-1, ÄÖ x_Y\x00z\U0001f600 [b]{c}"
    assert [t.decode() for t in lexical.terms(text)] == words(text)
    assert lexical.terms(None) == lexical.terms("") == lexical.terms(" ,;") == []


def test_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    asked = [tuple(r) for r in items.select("item_id", "text").collect()]
    check(lexical.search(docs, items), rows, asked)
    check(lexical.search(docs, items, terms_at_once=400, piece=3), rows, asked)


def test_sql_is_the_same():
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    docs, items = (con.sql(f"select {i}, text from {t}").fetchall() for i, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    assert sorted(con.sql(lexical.SEARCH_SQL).fetchall()) == sorted(plain(docs, items))


def test_odd_rows(tables):
    docs = [
        (1, None), (2, ""), (3, " ,.;!"), (4, "one two three"), (5, "ONE two, three"), (5, "one TWO three"),
        (None, "one two three"), (6, "word " * 200_000 + "rare"), (7, "Ärger ärger é"), (8, "rare rare words"),
        *((100 + i, "the same text of many copies") for i in range(30)),
    ]
    items = [(1, "one one two"), (1, "one one two"), (2, None), (3, "..."), (None, "rare word"), (4, "Ärger"), (5, "same copies"), (6, "absent")]
    for piece in (2, 4096):
        check(lexical.search(*tables(docs, items), piece=piece), docs, items)
    check(lexical.search(*tables(docs, []),), docs, [])
    check(lexical.search(*tables([], items)), [], items)


def test_a_bound_is_never_below_a_score():
    rows = [{"terms": [b"a", b"b"], "counts": [1, 3]}, {"terms": [b"b", b"c"], "counts": [2, 1]}]
    questions = lexical.Questions(rows, {b"a": 0, b"b": 1, b"c": 2}, lexical.np.array([5, 700, 40]))
    found, tfs, stops, members = (lexical.np.array(x) for x in ([0, 1, 1, 2], [2, 9, 1, 4], [1, 3, 4, 6], [0, 1, 2, 0, 1, 2]))
    scores = questions.scores(60, 3, found, tfs, stops, members, lexical.np.array([0, 1]))
    assert (questions.bounds(60, found, tfs)[:, None] >= scores).all() and (scores > 0).any()
