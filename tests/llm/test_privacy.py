from __future__ import annotations

import hashlib
import random
import re

from hypothesis import given
from hypothesis import strategies as st

from mailsift.llm import privacy


def luhn(digits):
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base(text):
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def spelled(spans):
    return ",".join(f"{privacy.KINDS[k]}:{s}:{e}" for s, k, e in spans)


@given(st.text(alphabet="ab@.-+ 012\n(é_%", max_size=60))
def test_entities_equal_the_patterns(text):
    assert [(s, k, e) for s, k, e, _ in privacy.entities(text)] == base(text)


def test_equals_plain_python_on_documents(sf_docs):
    df, rows = sf_docs
    text = {r.doc_id: r.text for r in rows}
    got = privacy.digest(privacy.scan(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(spelled(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]
        assert r.spans.startswith(spelled(want)) or r.n_term
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 0


def test_terms_that_give_an_entity_away(documents):
    rows = [{"doc_id": i, "text": f"letter {i} from Quillworth at q@mail.example.com and more of the {i}th"} for i in range(3)]
    rows += [{"doc_id": 10, "text": "later Quillworth wrote again"}]
    rows += [{"doc_id": 20 + i, "text": f"the letter at hand, from a friend, and more of it {i}"} for i in range(9)]
    docs = documents(rows)
    got = {r.doc_id: r for r in privacy.digest(privacy.scan(docs, disclosure=0.7)).collect()}
    text = rows[0]["text"]
    name = text.index("Quillworth")
    assert got[0].spans == f"term:{name}:{name + 10},email:{name + 14}:{name + 32}"
    assert got[10].spans == "term:6:16" and got[10].n_email == 0
    assert all(got[20 + i].spans == "" for i in range(9))
    spans = {r.doc_id: r.spans for r in privacy.scan(docs, disclosure=0.7).collect()}
    assert privacy.sanitise(text, spans[0]) == "letter 0 from [term] at [email] and more of the 0th"
    # At the default threshold the document without the address clears the term.
    assert all(r.n_term == 0 for r in privacy.digest(privacy.scan(docs)).collect())


def test_an_entity_counts_once_per_document(documents):
    long = "\n".join(f"line{i} contact q@mail.example.com about item{i}" for i in range(50))
    docs = documents([{"doc_id": 0, "text": long}, *({"doc_id": i, "text": f"contact us {i}"} for i in range(1, 11))])
    got = {r.doc_id: r for r in privacy.digest(privacy.scan(docs)).collect()}
    assert all(got[i].spans == "" for i in range(1, 11))


def test_terms_count_at_any_distance(documents):
    far = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [{"doc_id": i, "text": f"Quillworth {far(i, 40)} q@mail.example.com {far(i + 50, 9)}"} for i in range(10)]
    rows += [{"doc_id": 20 + i, "text": f"Umbrellina {far(i + 100, 30)}"} for i in range(10)]
    got = {r.doc_id: r for r in privacy.digest(privacy.scan(documents(rows))).collect()}
    assert all(got[i].spans.startswith("term:0:10,email:") and got[i].n_term == 1 for i in range(10))
    assert all(got[20 + i].spans == "" for i in range(10))


def told(rows, disclosure):
    """Disclosing terms by plain counting."""
    holds, where = {}, {}
    for text in rows:
        found = privacy.entities(text or "")
        near = {}
        for s, k, e, v in found:
            near.setdefault((k, v), []).append(privacy.surroundings(text, s, e))
        pieces = (text or "").split()
        first = {}
        for at, piece in enumerate(pieces):
            for t in privacy.TERM.findall(piece):
                first.setdefault(t.lower(), at)
        for t, at in first.items():
            holds[t] = holds.get(t, 0) + 1
            around = " ".join([*pieces[max(0, at - 8) : at], "|", *pieces[at + 1 : at + 9]]).lower()
            for entity, places in near.items():
                where.setdefault((t, entity), []).append((around, min(places)))
    return {
        t
        for (t, _), met in where.items()
        if len(met) >= disclosure * holds[t] and min(len({a for a, _ in met}), len({b for _, b in met})) >= 2
    }


def test_equals_plain_counts(documents):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(60)]
    kinds = ["a@b.example.org", "10.1.2.3", "c@d.example.org", "+1 202 555 01 99"]
    rows = []
    for i in range(120):
        text = rng.choices(words, k=rng.randrange(0, 9))
        for e in rng.sample(range(4), rng.choice([0, 0, 1, 1, 2])):
            text += [kinds[e], f"Name{e}"] if rng.random() < 0.95 else [kinds[e]]
            text += [f"tail{e}x{rng.randrange(6)}"]
        rng.shuffle(text)
        rows.append(" ".join(text) if i % 40 else None)
    for disclosure in (0.5, 0.9):
        df = documents([{"doc_id": i, "text": t} for i, t in enumerate(rows)])
        want = {privacy._hash(t) for t in told(rows, disclosure)}
        assert {r.term for r in privacy.disclosing_terms(df, disclosure).collect()} == want and want


def test_copies_count_once(documents):
    docs = documents([{"doc_id": i, "text": "ask Umbrellina at 10.0.0.1 now"} for i in range(5)])
    assert {r.spans for r in privacy.digest(privacy.scan(docs)).collect()} == {"ip:18:26"}


def test_odd_rows(odd_documents, documents):
    got = privacy.digest(privacy.scan(odd_documents)).collect()
    assert len(got) == 10 and all(r.spans == "" for r in got)
    assert privacy.digest(privacy.scan(documents([]))).collect() == []
    long = "1." * 5000 + "1 " + "4" * 6000
    assert [r.spans for r in privacy.digest(privacy.scan(documents([{"doc_id": 1, "text": long}]))).collect()][0].startswith("ip")
