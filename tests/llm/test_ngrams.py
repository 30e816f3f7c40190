from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mailsift.llm import ngrams
from mailsift.llm.elias_fano import EliasFano


@pytest.mark.parametrize("universe", [1, 7, 64, 1000, 10**6, 10**12])
def test_elias_fano(universe):
    rng = np.random.default_rng(universe)
    for n in (0, 1, 5, 300, 5000):
        values = np.sort(rng.integers(0, universe, n))
        coded = EliasFano.of(values, universe)
        assert (coded.get(np.arange(n)) == values.astype(np.uint64)).all()
        asked = np.append(rng.integers(0, universe, 500), values[:200])
        assert (coded.successor(asked) == np.searchsorted(values, asked)).all()


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def learns(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2


class Plain:
    """The same model with plain dictionaries and exact probabilities."""

    def __init__(self, docs, classes, inner):
        training = [tokens(t) for i, t in docs if learns(i)]
        self.count = Counter(w for t in training for w in t)
        self.n, self.v = sum(self.count.values()), len(self.count)
        hashes = {w: ngrams.word_hashes(w.decode())[0] for w in self.count if w is not None}
        order = sorted(hashes, key=lambda w: (-self.count[w], hashes[w]))
        self.klass = {None: 0} | {w: i + 1 for i, w in enumerate(order[:classes])}
        self.rest, self.inner = classes + 1, inner
        self.pairs, self.triples = Counter(), Counter()
        for t in training:
            for a, b, c in self.triples_of(t):
                self.pairs[b, c] += 1
                if a < inner and b < inner:
                    self.triples[a, b, min(c, inner)] += 1
        self.after, self.after2 = {}, {}
        for (h, w), n in self.pairs.items():
            self.after.setdefault(h, {})[w] = n
        for (a, b, w), n in self.triples.items():
            self.after2.setdefault((a, b), {})[w] = n

    def triples_of(self, t):
        k = [self.klass.get(w, self.rest) for w in t]
        return zip([0, 0, *k][: len(k)], [0, *k][: len(k)], k)

    def share(self, w):
        return (self.count[w] + 1) / (self.n + self.v + 1)

    def class_share(self, c):
        if c < self.rest:
            return {k: self.share(w) for w, k in self.klass.items()}.get(c, 0.0)
        return 1 - sum(self.share(w) for w in self.klass)

    def discounted(self, seen, w, shorter):
        total = sum(seen.values())
        if not total:
            return shorter
        return max(seen.get(w, 0) - 0.75, 0) / total + 0.75 * len(seen) / total * shorter

    def pair(self, h, w):
        return self.discounted(self.after.get(h, {}), w, self.class_share(w))

    def outer(self, h):
        return 1 - sum(self.pair(h, w) for w in range(self.inner))

    def given(self, a, b, c):
        if a >= self.inner or b >= self.inner:
            return self.pair(b, c)
        if c < self.inner:
            return self.discounted(self.after2.get((a, b), {}), c, self.pair(b, c))
        wide = self.discounted(self.after2.get((a, b), {}), self.inner, self.outer(b))
        return wide * self.pair(b, c) / self.outer(b)

    def score(self, text):
        total = 0.0
        for w, (a, b, c) in zip(tokens(text), self.triples_of(tokens(text))):
            own = self.share(w) / self.class_share(c) if c == self.rest else 1.0
            total += math.log10(self.given(a, b, c) * own)
        return total

    def base(self, text):
        return sum(math.log10(self.share(w)) for w in tokens(text))


def small_docs():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    weight = 1 / np.arange(1, 41)
    docs = []
    for i in range(80):
        start, text = rng.integers(40), []
        for _ in range(rng.integers(0, 40)):
            start = (start + 1) % 40 if rng.random() < 0.5 else rng.choice(40, p=weight / weight.sum())
            text.append(words[start])
        docs.append((i, " ".join(text)))
    return docs


@pytest.mark.parametrize("group_tokens", [ngrams.GROUP_TOKENS, 20])
def test_equals_plain_model(documents, monkeypatch, group_tokens):
    docs = small_docs()
    monkeypatch.setattr(ngrams, "CHUNK", 100)
    monkeypatch.setattr(ngrams, "BUCKET_WORDS", 5)
    monkeypatch.setattr(ngrams.frequent_words, "__defaults__", (12, 2048))
    plain = Plain(docs, classes=8, inner=4)
    df = documents([{"doc_id": i, "text": t} for i, t in docs]).repartition(3)
    got = {r.doc_id: r for r in ngrams.score(df, classes=8, inner=4, group_tokens=group_tokens).collect()}
    assert len(got) == 80
    for i, text in docs:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (not learns(i), len(tokens(text)), plain.n)
        assert r.n_known == sum(plain.count[w] > 0 for w in tokens(text))
        assert r.base_score == pytest.approx(plain.base(text), abs=1e-9)
        # Codes are 256 steps over about four decades.
        assert r.score == pytest.approx(plain.score(text), abs=0.012 * r.n_tokens)


def test_model_is_a_distribution():
    plain = Plain(small_docs(), classes=8, inner=4)
    for a, b in ((0, 0), (1, 2), (9, 1), (3, 9), (9, 9)):
        assert sum(plain.given(a, b, c) for c in range(10)) == pytest.approx(1.0)


def test_held_out_documents_gain_from_context(sf_docs):
    df, rows = sf_docs
    got = ngrams.score(df).collect()
    count = Counter(w for r in rows if learns(r.doc_id) for w in tokens(r.text))
    n, v = sum(count.values()), len(count)
    text = {r.doc_id: r.text for r in rows}
    for r in got:
        want = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(text[r.doc_id]))
        assert r.base_score == pytest.approx(want, abs=1e-6) and r.train_tokens == n
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(odd_documents, documents):
    got = {r.doc_id: r for r in ngrams.score(odd_documents).collect()}
    assert ngrams.score(odd_documents).count() == 10
    assert got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 1
    assert got[None].held_out is False and got[None].n_tokens > 5
    assert ngrams.score(documents([])).collect() == []
    (alone,) = ngrams.score(documents([{"doc_id": None, "text": "no one learns"}])).collect()
    assert (alone.train_tokens, alone.n_known, alone.base_score) == (0, 0, 0.0)


@pytest.mark.parametrize("hot", [ngrams.HOT_TOKENS, 150, 25, 0])
def test_no_word_is_left_out_of_pairs_and_triples(documents, monkeypatch, hot):
    """More words than any bounded alphabet had for triples, with context after the rare ones too."""
    rng = np.random.default_rng(9)
    docs = []
    for i in range(120):
        start, text = int(rng.integers(400)), []
        for _ in range(rng.integers(0, 60)):
            start = (start * 7 + 1) % 400 if rng.random() < 0.6 else int(400 * rng.random() ** 4)
            text.append(f"W{start}")
        docs.append((i if i % 10 else None, " ".join(text)))
    docs += [(1000 + i, "new words w1 w2 w3 end") for i in range(9)]
    monkeypatch.setattr(ngrams, "BUCKET_WORDS", 50)
    monkeypatch.setattr(ngrams, "SHARD_TOKENS", 300)
    monkeypatch.setattr(ngrams, "HOT_TOKENS", hot)
    monkeypatch.setattr(ngrams.frequent_words, "__defaults__", (60, 2048))
    plain = Plain(docs, classes=10_000, inner=20_000)
    shares = {k: plain.share(w) for w, k in plain.klass.items()}
    rest = 1 - sum(shares.values())
    plain.class_share = lambda c: shares.get(c, rest)
    df = documents([{"doc_id": i, "text": t} for i, t in docs]).repartition(3)
    got = sorted(ngrams.score(df, group_tokens=100).collect(), key=lambda r: (r.doc_id or -1, r.n_tokens, r.score))
    want = sorted(((i, len(tokens(t)), plain.score(t), plain.base(t)) for i, t in docs), key=lambda r: (r[0] or -1, *r[1:3]))
    assert len(got) == len(want)
    for r, (i, n, score, base) in zip(got, want):
        assert (r.doc_id, r.n_tokens, r.train_tokens) == (i, n, plain.n)
        assert r.score == pytest.approx(score, abs=1e-5) and r.base_score == pytest.approx(base, abs=1e-9)


def test_words_are_hashed_as_bytes_split_them():
    """Each word has one hash, wherever it stands and whatever its length, also across pieces of texts."""
    rng = np.random.default_rng(5)
    pool = ["a", "A", "é", "É", "b\x00", "\u2028x", "x" * 64, "x" * 65, "x" * 66, "y" * 700_000, *(f"W{i}" for i in range(500))]
    gaps = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c"]
    texts = [None, "", " ", "end", "\tA a\n", *("".join(pool[rng.integers(len(pool))] + gaps[rng.integers(len(gaps))] for _ in range(60)) for _ in range(40)), "end"]
    rows = [pa.record_batch({"row": list(range(len(part))), "text": pa.array(part, pa.string())}) for part in (texts, [])]
    got = list(ngrams._chunks(iter([*rows, rows[0].slice(7)])))
    want = [w for t in [*texts, *texts[7:]] for w in tokens(t)]
    hashes = np.concatenate([t for _, t, _ in got]).tolist()
    assert len(hashes) == len(want)
    by_word = dict(zip(want, hashes))
    assert [by_word[w] for w in want] == hashes and len(set(by_word.values())) == len(by_word)
    assert [len(tokens(t)) for t in [*texts, *texts[7:]]] == [n for rows, _, text in got for n in np.bincount(text, minlength=len(rows))]
    assert ngrams.word_hashes("End") == [by_word[b"end"], ngrams.END]


def questions(docs, monkeypatch):
    """How many tokens ask for a value by key."""
    asked, staged = [], ngrams.staged

    def kept(df, label):
        out = staged(df, label)
        if label == "ngram-scored":
            asked.append(out.filter(f"kind = {ngrams._ASKED}").agg({"n": "sum"}).first()[0] or 0)
        return out

    monkeypatch.setattr(ngrams, "staged", kept)
    ngrams.score(docs).collect()
    return asked[0]


def test_what_follows_a_hot_word_is_not_asked_for_by_each_token(documents, monkeypatch):
    """Contexts of two words are learned in shards, and frequent pairs are broadcast; only rare ones ask."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(30 * rng.random() ** 3)}" for _ in range(50)) for _ in range(60)]
    docs = documents([{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    monkeypatch.setattr(ngrams, "SHARD_TOKENS", 300)
    monkeypatch.setattr(ngrams, "HOT_TOKENS", 500)
    assert questions(docs, monkeypatch) == 0


@pytest.mark.parametrize("pairs", [0, 40])
def test_rare_pairs_after_hot_words_are_asked_for(documents, monkeypatch, pairs):
    monkeypatch.setattr(ngrams, "FREQUENT_PAIRS", pairs)
    test_no_word_is_left_out_of_pairs_and_triples(documents, monkeypatch, 25)
