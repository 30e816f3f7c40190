from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from mailsift.llm import neighbours

from .conftest import SF


def plain(rows, k=20, every=20):
    rows = [(i, np.array(v, np.float64)) for i, v in rows]
    out = {}
    for q, x in rows:
        if q % every == 0:
            scores = sorted((-float((x * v).sum()), i) for i, v in rows if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def got(df, **kwargs):
    out = defaultdict(list)
    for r in sorted(neighbours.nearest(df, **kwargs).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def recall(found, want):
    return np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


@pytest.fixture
def embeddings(spark):
    return lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = plain([(r.vec_id, r.embedding) for r in df.collect()])
    found = got(df)
    assert set(found) == set(want) and recall(found, want) >= 0.9
    truth = {(q, i): s for q in want for i, s in want[q]}
    for q in found:
        for i, s in found[q]:
            assert s == pytest.approx(truth.get((q, i), s), abs=1e-12)


def test_forest_of_small_leaves_with_lengths(embeddings):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] * (1 + i % 3) + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1500)]
    found, want = got(embeddings(rows), leaf=40, probes=60), plain(rows)
    assert recall(found, want) >= 0.9


def test_trees_from_a_sample_index_every_row(embeddings, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 200)
    monkeypatch.setattr(neighbours, "PART", 50)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(1200)]
    found, want = got(embeddings(rows), leaf=100, probes=10_000), plain(rows)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_probes_grow_until_the_recall_is_reached(embeddings):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(4000)]
    assert recall(got(embeddings(rows), leaf=16, probes=4), plain(rows)) >= 0.9


def test_equal_vectors_and_ties(embeddings):
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(i, [0.0, 1.0]) for i in range(100, 130)]
    found = got(embeddings(rows))
    assert found == plain(rows)
    assert [i for i, _ in found[0]] == list(range(1, 21))


def test_odd_rows(spark, embeddings):
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.0, 0.0]),
        (6, [3.0, 1.0]), (6, [3.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, []), (20, [1.0, 2.0]), (40, None), (None, [1.0, 1.0]),
    ]
    df = embeddings(rows).selectExpr("*", "'x' as point", "'x' as score", "'x' as leaf")
    assert got(df) == {0: [(6, 5.0), (20, 5.0)], 20: [(0, 5.0), (6, 5.0)]}
    assert got(embeddings([])) == {}
    assert got(embeddings([(20, [1.0])])) == {}
