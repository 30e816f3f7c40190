from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from mailsift.llm import packing
from mailsift.llm.queries import op3_harmonic_packing, tokenizer_files

from .conftest import SF


def plain_ids(text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_files()[0])
    return plain.encode(text or "", add_special_tokens=False).ids + [0]


def check_whole(rows, texts):
    """Pieces make up each document; sequences are gapless and within capacity."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in pieces]).tolist()
        assert ids == plain_ids(texts[doc_id])
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
        assert all(r.doc_tokens == len(ids) for r in pieces)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
        padding += packing.CAPACITY - at
        total += at
    return padding / total


def test_round_trip(sf_docs):
    df, rows = sf_docs
    pieces = packing.pack(df, *tokenizer_files()).collect()
    assert check_whole(pieces, {r.doc_id: r.text for r in rows}) < 0.02


def test_query_digest(spark, sf_docs):
    import zlib

    df, _ = sf_docs
    ids = {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in packing.pack(df, *tokenizer_files()).collect()}
    got = {(r.doc_id, r.start): r.ids_crc32 for r in op3_harmonic_packing(spark, SF).collect()}
    assert got == ids


def test_odd_rows(odd_documents):
    pieces = packing.pack(odd_documents, *tokenizer_files()).collect()
    rows = odd_documents.collect()
    assert sum(r.length for r in pieces) == sum(len(plain_ids(r.text)) for r in rows)
    single = odd_documents.filter("doc_id is null or doc_id != 7")
    pieces = packing.pack(single, *tokenizer_files()).collect()
    check_whole(pieces, {r.doc_id: r.text for r in single.collect()})


def test_empty(documents):
    assert packing.pack(documents([]), *tokenizer_files()).collect() == []


@pytest.mark.parametrize("text", ["<|endoftext|> and more", "a" * 5000, "  spaced   out \n\n text ", "naïve été 日本語 123 !!"])
def test_tokens_equal_the_plain_tokenizer(text):
    assert [*packing.tokenizer(*tokenizer_files()).encode(text).tolist(), 0] == plain_ids(text)


def test_cut_texts_have_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "LONG_TEXT", 50)
    monkeypatch.setattr(packing, "PIECE_TEXT", 20)
    text = "It's a 12 test, with d'accord  double  blanks\n and lines don't end here  x yz " * 9 + "q" * 90
    assert "".join(packing.cut_text(text)) == text and len(list(packing.cut_text(text))) > 5
    assert [*packing.tokenizer(*tokenizer_files()).encode(text).tolist(), 0] == plain_ids(text)


@pytest.mark.parametrize("total", [1, 63, 64, 65, 341, 342, 511, 512, 513, 1023, 1024, 1025, 5000])
def test_cuts(total):
    lengths = packing.cut_lengths(total)
    assert sum(lengths) == total and all(0 < n <= 1024 for n in lengths)
    for n in lengths:
        k = 1024 // n
        assert n == 1024 // k or n <= packing.UNCUT
