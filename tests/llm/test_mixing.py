from __future__ import annotations

import re
from collections import defaultdict

import pytest

from mailsift.llm import mixing


def plain_targets(sizes):
    """Targets by sharing the excess again and again; sizes in order of names."""
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    total, done = sum(sizes), {}
    while len(done) < len(sizes):
        left = total - sum(done.values())
        weight = sum(w for i, w in enumerate(weights) if i not in done)
        over = [i for i, w in enumerate(weights) if i not in done and left * w / weight > 3 * sizes[i]]
        if not over:
            return [done.get(i, left * w / weight) for i, w in enumerate(weights)]
        done |= {i: 3 * sizes[i] for i in over}
    return [done[i] for i in range(len(sizes))]


def highest_quotients(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min((n for n in votes if votes[n]), key=lambda n: (-votes[n] / (2 * won[n] + 1), n))
        won[best] += 1
    return won


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 3, 50, 7], [5], [0, 10, 0], [10, 10_000, 10_000], [1, 1, 1, 1, 900]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.targets(df).orderBy("source").collect()]
    assert got == pytest.approx(plain_targets(sizes))


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1001])
def test_seats_are_the_highest_quotients(spark, seats):
    votes = {"a": 53, "b": 24, "c": 23, "d": 0, "e": 1, "f": 899, "g": 24, "h": 3}
    df = spark.createDataFrame([(1, n, v, seats) for n, v in votes.items()], "x int, name string, votes long, seats int")
    got = {r["name"]: r.won for r in mixing.apportion(df, ["x"], "name", "votes", "seats").collect()}
    assert got == highest_quotients(votes, seats)


def words(text):
    return len(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))


def check(rows, docs):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d.source] += words(d.text)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(names, plain_targets([sizes[n] for n in names])))
    source = {d.doc_id: d.source for d in docs}
    taken = defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    return {s: (taken[s], target[s]) for s in names}


def test_sources_come_near_their_targets(sf_docs):
    df, docs = sf_docs
    rows = mixing.mix(df).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: r.size for r in rows} == {d.doc_id: words(d.text) for d in docs}
    for taken, target in check(rows, docs).values():
        assert abs(taken - target) <= 3 + target * 0.01
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_many_shards_and_large_blocks(sf_docs):
    df, docs = sf_docs
    rows = mixing.mix(df, blocks=500, shard_rows=3).collect()
    block = sum(r.size for r in rows) // 500
    for taken, target in check(rows, docs).values():
        assert abs(taken - target) <= 2 * block


def test_odd_rows(odd_documents, documents):
    rows = mixing.mix(odd_documents).collect()
    assert len(rows) == 10
    assert {r.doc_id: r.taken for r in rows if r.size == 0} == {1: 0, 2: 0, 3: 0}
    assert mixing.mix(documents([])).collect() == []
    assert [r.taken for r in mixing.mix(documents([{"doc_id": 1}, {"doc_id": 2, "text": " "}])).collect()] == [0, 0]
