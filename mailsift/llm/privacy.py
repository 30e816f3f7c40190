"""Personal data: pattern spans, and terms that give protected entities away.

Patterns find e-mail and network addresses, card and telephone numbers: the protected
entities. Terms and entities of a document are counted together over the corpus, however
far apart they stand. A term t reveals an entity e as far as p(e | t) is high: the
documents that hold both, over all documents that hold t. Terms above the disclosure
threshold are marked, and ``sanitise`` replaces marked terms and entities by their kinds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import key_filter, may_hold, staged

# The base patterns in the order of their kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "term")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
TERM = re.compile(r"[^\W_][\w'-]+")
# Words on each side that make up the surroundings, by which copies are told from other texts.
NEAR = 8
# Share of a term's documents that hold the entity, from which on it discloses.
DISCLOSURE = 0.9
# Different surroundings of the term, and of the entity, in which they must have met.
SUPPORT = 2
# Rows of meetings that a worker puts out at once.
MEETINGS = 1 << 18
# Bits of the filter that finds candidate terms; false hits are joined away.
FILTER_BITS = 1 << 23
# Documents that a worker looks into at once.
BATCH_ROWS = 1000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def entities(text: str) -> list[tuple[int, int, int, str]]:
    """Base spans as (start, kind, end, normalised value), by start, then kind."""
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end(), m[0].lower()) for m in emails(text)]
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end(), m[0]))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in PHONE.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if 9 <= len(digits) <= 15:
                found.append((m.start(), 3, m.end(), digits))
    return sorted(found)


def emails(text: str) -> Iterator[re.Match]:
    """Matches of EMAIL, looked for around each @ only.

    The part before an @ is the whole run of its characters that ends there, cut off at
    the end of the match before; that is where the leftmost match begins.
    """
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        match = EMAIL.match(text, start) if start < at else None
        if match:
            yield match
            done = at = match.end()
        else:
            at += 1


def _hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)


def surroundings(text: str, start: int, end: int) -> int:
    """A hash of the terms within NEAR words of a span."""
    before = [m[0].lower() for m in TERM.finditer(" ".join(text[:start].rsplit(None, NEAR)[-NEAR:]))]
    after = [m[0].lower() for m in TERM.finditer(" ".join(text[end:].split(None, NEAR)[:NEAR]))]
    return _hash(" ".join([*before, "|", *after]))


def _entity_hash(kind: int, value: str) -> int:
    return _hash(f"{kind}:{value}")


def repeated_entities(rows: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(entity): hashes of the entities that at least ``support`` documents hold; no others can be disclosed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[int] = []
            for text in batch.column("text").to_pylist():
                found += {_entity_hash(kind, value) for _, kind, _, value in entities(text or "")}
            values, counts = np.unique(np.array(found, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["entity", "n"])

    counted = rows.select("text").mapInArrow(run, "entity long, n long").groupBy("entity").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= support).select("entity")


def _let_through(found: list[tuple[int, int, int, str]], table: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans as (hash of the entity, start, end), of the entities that a filter lets through."""
    hashes = np.array([_entity_hash(kind, value) for _, kind, _, value in found], np.int64)
    return [(int(hashes[i]), found[i][0], found[i][2]) for i in np.flatnonzero(may_hold(table, hashes))]


def terms_with_entities(rows: DataFrame, repeated: np.ndarray) -> DataFrame:
    """(term, beside): in how many documents with a repeated entity each of their terms is, wherever it stands."""
    shared = rows.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            found: list[int] = []
            for text in batch.column("text").to_pylist():
                if (spans := entities(text or "")) and _let_through(spans, shared.value):
                    found += {_hash(t) for t in {w.lower() for w in TERM.findall(text)}}
            terms, counts = np.unique(np.array(found, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts)], names=["term", "n"])

    return rows.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("beside"))


def surroundings_of_terms(text: str, table: np.ndarray) -> list[tuple[int, int]]:
    """Terms of a text that a filter lets through, with a hash of the words around the first place of each."""
    pieces = text.split()
    first: dict[str, int] = {}
    for place, piece in enumerate(pieces):
        for term in TERM.findall(piece):
            first.setdefault(term.lower(), place)
    words = list(first)
    hashes = np.array([_hash(w) for w in words], np.int64)
    out = []
    for i in np.flatnonzero(may_hold(table, hashes)):
        at = first[words[i]]
        around = [*pieces[max(0, at - NEAR) : at], "|", *pieces[at + 1 : at + 1 + NEAR]]
        out.append((int(hashes[i]), _hash(" ".join(around).lower())))
    return out


def meetings(rows: DataFrame, terms: np.ndarray, repeated: np.ndarray) -> DataFrame:
    """(term, entity, near_term, near_entity), as hashes: one row per document that holds both, at any distance.

    Both filters only spare rows. The surroundings of an entity with several places are the smallest hash.
    """
    shared = rows.sparkSession.sparkContext.broadcast((terms, repeated))
    names = ["term", "entity", "near_term", "near_entity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_terms, known = shared.value
        held: list[np.ndarray] = []
        size = 0

        def emit() -> pa.RecordBatch:
            table = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(table[:, i])) for i in range(4)], names=names)

        for batch in batches:
            for text in batch.column("text").to_pylist():
                spans = _let_through(entities(text or ""), known)
                if not spans or not (found := surroundings_of_terms(text, known_terms)):
                    continue
                near: dict[int, int] = {}
                for entity, start, end in spans:
                    around = surroundings(text, start, end)
                    near[entity] = min(near.get(entity, around), around)
                sides = np.array(found, np.int64)
                others = np.array(list(near.items()), np.int64)
                step = max(1, MEETINGS // len(others))
                for at in range(0, len(sides), step):
                    t, e = sides[at : at + step].repeat(len(others), 0), np.tile(others, (len(sides[at : at + step]), 1))
                    held.append(np.stack([t[:, 0], e[:, 0], t[:, 1], e[:, 1]], 1))
                    size += len(t)
                    if size >= MEETINGS:
                        yield emit()
                        held, size = [], 0
        if held:
            yield emit()

    return rows.select("text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def held_terms(text: str, table: np.ndarray) -> dict[str, int]:
    """The spellings in a text that a filter of terms lets through, with their hashes."""
    words = list(set(TERM.findall(text)))
    hashes = np.array([_hash(w.lower()) for w in words], np.int64)
    return {words[i]: int(hashes[i]) for i in np.flatnonzero(may_hold(table, hashes))}


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most BATCH_ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def term_documents(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """(term, documents): in how many documents the terms of a filter are."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            found: list[int] = []
            if shared.value.any():
                for text in batch.column("text").to_pylist():
                    found += set(held_terms(text or "", shared.value).values())
            terms, counts = np.unique(np.array(found, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts)], names=["term", "n"])

    counted = rows.select("text").mapInArrow(run, "term long, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("documents"))


def disclosing_terms(rows: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """Terms of which at least ``disclosure`` of the documents hold one entity, anywhere in the text.

    A pair counts once per document. Only terms are followed that could still reach the share: of their
    documents, enough hold some entity that ``support`` documents have. A text and its copies would
    disclose all their words, so the documents of a pair must show ``support`` different surroundings
    of the entity, and as many of the term. With 2, the least number that is more than one text,
    an entity that is in one text only, or in copies of it, is disclosed by none of its words.
    """
    repeated = key_filter(repeated_entities(rows, support), F.col("entity"), FILTER_BITS)
    beside = terms_with_entities(rows, repeated).filter(F.col("beside") >= support)
    beside = staged(beside, "privacy-beside")
    spread = term_documents(rows, key_filter(beside, F.col("term")))
    reach = beside.join(spread, "term").filter(F.col("beside") >= disclosure * F.col("documents"))
    reach = staged(reach.select("term", "documents"), "privacy-reach")
    pairs = (
        meetings(rows, key_filter(reach, F.col("term"), FILTER_BITS), repeated)
        .groupBy("term", "entity", "near_term", "near_entity")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("term", "entity")
        .agg(
            F.sum("n").alias("together"),
            F.count_distinct("near_term").alias("term_places"),
            F.count_distinct("near_entity").alias("entity_places"),
        )
    )
    told = pairs.filter((F.col("term_places") >= support) & (F.col("entity_places") >= support)).join(reach, "term")
    told = told.filter(F.col("together") >= disclosure * F.col("documents"))
    return staged(told.select("term").distinct(), "privacy-terms")


def scan(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """doc_id and ``spans`` (start, kind, end): entities and disclosing terms.

    Null and empty texts have no spans. A null doc_id is carried; repeated rows are
    documents of their own with equal spans. Only doc_id and text are read; terms inside
    an entity are not marked. Counts are taken over all documents.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    disclosing = disclosing_terms(rows, disclosure, support)
    table = docs.sparkSession.sparkContext.broadcast(key_filter(disclosing, F.col("term"), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = table.value.any()
        for batch in _parts(batches):
            marks, sizes = [], []
            for text in batch.column("text").to_pylist():
                found = [(s, k, e, 0) for s, k, e, _ in entities(text or "")]
                if some and (hits := held_terms(text or "", table.value)):
                    found += [(m.start(), 4, m.end(), hits[m[0]]) for m in TERM.finditer(text) if m[0] in hits]
                marks += found
                sizes.append(len(found))
            flat = np.array(marks, np.int64).reshape(-1, 4)
            fields = [pa.array(flat[:, 0]), pa.array(flat[:, 1].astype(np.int32)), pa.array(flat[:, 2]), pa.array(flat[:, 3])]
            structs = pa.StructArray.from_arrays(fields, names=["start", "kind", "end", "term"])
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(offsets, structs)], names=["doc_id", "marks"]
            )

    marked = rows.mapInArrow(run, "doc_id long, marks array<struct<start:long,kind:int,end:long,term:long>>")
    marked = staged(marked.withColumn("row", F.monotonically_increasing_id()), "privacy-marks")
    base = F.transform(
        F.filter("marks", lambda m: m["kind"] < 4), lambda m: F.struct(m["start"], m["kind"], m["end"])
    )
    kept = (
        marked.select("row", F.explode("marks").alias("m"))
        .filter("m.kind = 4")
        .select("row", "m.*")
        .join(disclosing, "term")
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("terms"))
    )
    free = F.filter(
        "terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    )
    has_terms = F.exists("marks", lambda m: m["kind"] == 4)
    plain = marked.filter(~has_terms).select("doc_id", base.alias("spans"))
    held = (
        marked.filter(has_terms)
        .join(kept, "row", "left")
        .withColumn("base", base)
        .select("doc_id", F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", free))).alias("spans"))
    )
    return plain.unionByName(held)


def sanitise(text: str, spans: list) -> str:
    """The text with its spans replaced by their kinds; overlapping spans become one."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and digest of the spans."""
    names = F.array(*map(F.lit, KINDS))

    def spelled(spans):
        return F.array_join(
            F.transform(
                spans,
                lambda s: F.concat_ws(
                    ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
                ),
            ),
            ",",
        )

    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(5)],
        F.sha2(spelled(F.filter("spans", lambda s: s["kind"] < 4)), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )
