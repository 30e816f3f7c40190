"""Ranked lexical search over a length-stratified index.

A document's score for an item depends on its length only through the normaliser m, so documents
of equal m form a stratum. A stratum is stored in pieces of at most ``PIECE`` documents; a piece
holds its postings by term and, within a term, by falling frequency. What a term adds to a score
is then computed once per frequency, and the first frequency of each term bounds the whole piece.

1. The texts are read once: lengths and the frequencies of the items' terms are written down,
   the only words that can matter. Document counts of the terms are aggregates over that.
2. The strata are sorted and written as pieces.
3. Each item visits the pieces of its highest bounds; the tenth score found there is a floor.
4. All pieces are gone through; an item passes over those whose bound is below its floor, which
   rises as better documents are found. No document of a piece passed over could be among the ten.

Items are handled in blocks of about ``TERMS`` terms, so what travels to the tasks is bounded.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.common import staged

TOP = 10
PIECE = 4096
# Terms of a block of items, counted once per item, and items of a block.
TERMS, ITEMS = 1 << 18, 1 << 9
# Documents that a task scores, about.
DOCUMENTS = 1 << 13
# Pieces per item that the first visit looks at.
FIRST = 4

# A-Z become small; bytes outside of letters, digits and UTF-8 sequences separate terms.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)

_STRATUM = "m long, docs array<long>, terms array<int>, tfs array<long>, stops array<int>, members array<int>"


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order; none for a null text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


def _item_terms(items: DataFrame) -> DataFrame:
    """item, item_id, block-free counts of each item's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item"),
                    batch.column("item_id"),
                    pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                    pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())),
                ],
                names=["item", "item_id", "terms", "counts"],
            )

    rows = items.select(
        F.monotonically_increasing_id().alias("item"),
        F.col("item_id").cast("long").alias("item_id"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(run, "item long, item_id long, terms array<binary>, counts array<long>")


def _frequencies(docs: DataFrame, words) -> DataFrame:
    """doc_id, n (terms of the text) and the frequencies of the broadcast terms, of texts that hold any term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value.get
        for batch in batches:
            ids, sizes, found, tfs = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                split = terms(text)
                if split:
                    counts = Counter(map(known, split))
                    counts.pop(None, None)
                    ids.append(doc_id)
                    sizes.append(len(split))
                    found.append(list(counts))
                    tfs.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(found, pa.list_(pa.int32())),
                    pa.array(tfs, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def _pieces(rows: DataFrame, piece: int) -> DataFrame:
    """Strata of a table that is sorted by m within its partitions, in pieces of postings by term and frequency."""

    def stratum(m: int, docs: list, found: list, tfs: list) -> dict:
        member = np.repeat(np.arange(len(docs)), [len(t) for t in found])
        term, tf = np.fromiter((t for f in found for t in f), np.int64), np.fromiter((t for f in tfs for t in f), np.int64)
        order = np.lexsort((-tf, term))
        term, tf, member = term[order], tf[order], member[order]
        last = np.append((term[1:] != term[:-1]) | (tf[1:] != tf[:-1]), True) if len(term) else np.zeros(0, bool)
        stops = np.flatnonzero(last)
        return {
            "m": m,
            "docs": docs,
            "terms": term[stops].tolist(),
            "tfs": tf[stops].tolist(),
            "stops": (stops + 1).tolist(),
            "members": member.tolist(),
        }

    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    schema = pa.schema(list(zip(("m", "docs", "terms", "tfs", "stops", "members"), kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, docs, found, tfs = None, [], [], []
        for batch in batches:
            out = []
            for m, doc_id, t, f in zip(*(batch.column(c).to_pylist() for c in ("m", "doc_id", "terms", "tfs"))):
                if docs and (m != current or len(docs) == piece):
                    out.append(stratum(current, docs, found, tfs))
                    docs, found, tfs = [], [], []
                current = m
                docs.append(doc_id)
                found.append(t)
                tfs.append(f)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if docs:
            yield pa.RecordBatch.from_pylist([stratum(current, docs, found, tfs)], schema=schema)

    return rows.mapInArrow(run, _STRATUM)


class Questions:
    """A block of items: for each term its weight, and the items that hold it, how often."""

    def __init__(self, rows: list, words: dict[bytes, int], weights: np.ndarray):
        pairs = sorted((words[t], i, c) for i, r in enumerate(rows) for t, c in zip(r["terms"], r["counts"]))
        term, item, count = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), (), ())))
        self.size, self.weights, self.item, self.count = len(rows), weights, item, count
        self.start = np.searchsorted(term, np.arange(len(words) + 1))

    def impacts(self, m: int, found: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        return self.weights[found] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m))

    def bounds(self, m: int, found: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """No document of the piece scores more than this for each item."""
        first = np.append(True, found[1:] != found[:-1]) if len(found) else np.zeros(0, bool)
        found, best = found[first], self.impacts(m, found[first], tfs[first])
        width = self.start[found + 1] - self.start[found]
        place = np.repeat(self.start[found] - np.append(0, np.cumsum(width))[:-1], width) + np.arange(width.sum())
        out = np.zeros(self.size, np.int64)
        np.add.at(out, self.item[place], self.count[place] * np.repeat(best, width))
        return out

    def scores(self, m: int, docs: int, found: np.ndarray, tfs: np.ndarray, stops: np.ndarray, members: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Scores of the active items (rows) for the piece's documents."""
        row = np.full(self.size, -1)
        row[active] = np.arange(len(active))
        out = np.zeros((len(active), docs), np.int64)
        gains = np.repeat(self.impacts(m, found, tfs), np.diff(stops, prepend=0))
        lasts = np.flatnonzero(np.append(found[1:] != found[:-1], True)) if len(found) else []
        begin = 0
        for last in lasts:
            end, term = stops[last], found[last]
            part = slice(self.start[term], self.start[term + 1])
            rows, counts = row[self.item[part]], self.count[part]
            asked = rows >= 0
            if asked.any():
                out[rows[asked][:, None], members[begin:end]] += counts[asked][:, None] * gains[begin:end]
            begin = end
        return out


def _unpacked(batch: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of lists as numpy arrays, without a Python object per element."""
    for i in range(batch.num_rows):
        yield tuple(batch.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)


def _first_visits(index: DataFrame, asked) -> DataFrame:
    """(item, bound, m, piece_doc): each task's pieces of highest bound for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in range(asked.value.size)]
        for batch in batches:
            names = batch.column("name").to_pylist()
            for name, m, (found, tfs) in zip(names, batch.column("m").to_pylist(), _unpacked(batch, ("terms", "tfs"))):
                bounds = asked.value.bounds(m, found, tfs)
                for i in np.flatnonzero(bounds > 0):
                    here = best[i]
                    if len(here) < FIRST or bounds[i] > here[-1][0]:
                        here.append((int(bounds[i]), name))
                        here.sort(reverse=True)
                        del here[FIRST:]
        out = [(i, *b) for i, rows in enumerate(best) for b in rows]
        columns = [pa.array(list(c), pa.int64()) for c in (zip(*out) if out else [()] * 3)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "bound", "name"])

    return index.select("name", "m", "terms", "tfs").mapInArrow(run, "item long, bound long, name long")


def _best(index: DataFrame, asked, floors) -> DataFrame:
    """(item, score, doc_id): the TOP documents of each item in each task.

    A column ``items`` restricts a piece to some items. ``floors`` are scores that an item's
    TOPth document is known to have.
    """

    def merged(held: list[tuple], scores: np.ndarray, docs: list) -> list[tuple]:
        if len(scores) > TOP:
            least = np.partition(scores, -TOP)[-TOP]
            keep = np.flatnonzero(scores >= least)
            scores, docs = scores[keep], [docs[k] for k in keep]
        held += [(-int(s), d is None, d) for s, d in zip(scores, docs)]
        return sorted(held, key=lambda x: (x[0], x[1], x[2] or 0))[:TOP]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, floor = asked.value, np.maximum(floors.value, 1)
        best: list[list[tuple]] = [[] for _ in range(questions.size)]
        for batch in batches:
            chosen = batch.column("items").to_pylist() if "items" in batch.schema.names else None
            rows = _unpacked(batch, ("terms", "tfs", "stops", "members"))
            for k, (m, (found, tfs, stops, members)) in enumerate(zip(batch.column("m").to_pylist(), rows)):
                may = questions.bounds(m, found, tfs) >= floor
                if chosen is not None:
                    may &= np.isin(np.arange(questions.size), chosen[k])
                active = np.flatnonzero(may)
                if not len(active):
                    continue
                docs = batch.column("docs")[k].as_py()
                scores = questions.scores(m, len(docs), found, tfs, stops, members, active)
                good = scores >= floor[active][:, None]
                for j in np.flatnonzero(good.any(axis=1)):
                    at, i = np.flatnonzero(good[j]), active[j]
                    best[i] = merged(best[i], scores[j, at], [docs[a] for a in at])
                    if len(best[i]) == TOP:
                        floor[i] = max(floor[i], -best[i][-1][0])
        out = [(i, -s, d) for i, rows in enumerate(best) for s, _, d in rows]
        columns = [pa.array(list(c), pa.int64()) for c in (zip(*out) if out else [()] * 3)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "score", "doc_id"])

    return index.mapInArrow(run, "item long, score long, doc_id long")


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)


def _search_block(docs: DataFrame, rows: list, piece: int) -> DataFrame:
    """item (place in ``rows``), rank, doc_id and score for one block of items."""
    spark = docs.sparkSession
    words = {t: i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
    shared = spark.sparkContext.broadcast(words)
    lengths = staged(_frequencies(docs, shared), "lexical-lengths")
    n, total = lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = lengths.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(len(words), np.int64)
    df[held.column("term").to_numpy()] = held.column("df").to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    asked = spark.sparkContext.broadcast(Questions(rows, words, weights))
    strata = lengths.filter(F.size("terms") > 0).withColumn("m", F.expr(f"25 + (75 * n * {n}L) div {max(total, 1)}L"))
    strata = strata.repartitionByRange("m", "doc_id").sortWithinPartitions("m", "doc_id").drop("n")
    index = staged(_pieces(strata, piece).withColumn("name", F.monotonically_increasing_id()), "lexical-index")
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "name")
    visits = _first_visits(index, asked).withColumn("k", F.row_number().over(by_bound)).filter(F.col("k") <= FIRST)
    visits = visits.groupBy("name").agg(F.collect_list("item").alias("items"))
    none = spark.sparkContext.broadcast(np.zeros(len(rows), np.int64))
    seen = _ranked(_best(index.join(visits, "name"), asked, none)).filter(F.col("rank") == TOP).select("item", "score").toArrow()
    floors = np.zeros(len(rows), np.int64)
    floors[seen.column("item").to_numpy()] = seen.column("score").to_numpy()
    # Scoring takes far more time than reading, so pieces are dealt by number and not by bytes.
    parts = min(1 << 16, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // DOCUMENTS)))
    return _ranked(_best(index.repartition(parts, "name"), asked, spark.sparkContext.broadcast(floors)))


def search(docs: DataFrame, items: DataFrame, terms_at_once: int = TERMS, piece: int = PIECE) -> DataFrame:
    """item_id, rank, doc_id and score of the TOP best documents of each item, best first.

    A null text has no terms: such a document is not counted and such an item finds nothing, as do
    items without a known term, and items where no score is above 0. Equal scores go by doc_id,
    nulls last. Repeated rows of either table stand for themselves: a document's rows are ranked
    one by one, an item's rows each have their list. Empty tables give no rows. Of ``docs`` only
    doc_id and text are read, of ``items`` item_id and text.
    """
    spark = docs.sparkSession
    asked = staged(_item_terms(items), "lexical-items")
    count, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, math.ceil(size / terms_at_once), math.ceil(count / ITEMS))
    found = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item").collect()
        if not any(r["terms"] for r in rows):
            continue
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item long, item_id long")
        part = _search_block(docs, rows, piece).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        if blocks > 1:
            part = staged(part, "lexical-block")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found


# The same ranking in DuckDB SQL, for tables with unique ids.
SEARCH_SQL = r"""
with words as (
  select doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents),
tf as (select doc_id, term, count(*) as tf from words group by doc_id, term),
lengths as (select doc_id, count(*) as n from words group by doc_id),
totals as (select count(*) as docs, cast(sum(n) as bigint) as total from lengths),
weights as (
  select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w
  from (select term, count(*) as df from tf group by term), totals),
norms as (select doc_id, 25 + (75 * n * docs) // total as m from lengths, totals),
asked as (
  select item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
counts as (select item_id, term, count(*) as qf from asked group by item_id, term),
scores as (
  select item_id, doc_id, cast(sum(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from counts join weights using (term) join tf using (term) join norms using (doc_id)
  group by item_id, doc_id)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
where rank <= 10
"""
