"""Removal of long repeated strings, by prefix-free parsing of the corpus.

A string of ``LENGTH`` bytes that starts in two places makes all its bytes repeated.
Rolling hashes cut texts into phrases at triggers. A string that starts t bytes before a
trigger is a phrase's suffix of t bytes and what the parse has from the trigger on, so
two such strings are neighbours in corpus order exactly if their phrase suffixes are
equal and their places in the order of the parse are next to each other.

1. Triggers are counted by their passage, some bytes after them that every string over them
   holds, and those that are left by their core, all such bytes. What occurs once can be in no
   repeated string; most of the corpus ends here.
2. Triggers with equal surroundings all around are repeated as a whole.
3. The other distinct surroundings of a trigger, its dictionary, are put in order: the
   texts after it (the parse) are sorted once, phrase suffixes are sorted from their
   ends, and both orders with their common prefixes give the order of all strings, in
   which neighbours with a common prefix of LENGTH bytes are repeated. Dictionaries that
   are too large for one task are split by longer common parts first.
4. Covered bytes are cut out of each text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import key_filter, may_hold, staged

LENGTH = 400
# A trigger is a 16-gram whose hash is 0 modulo EVERY. Where REACH 16-grams in a row hold
# none, the smallest hash among them is the trigger, so every string has one near its start.
EVERY, REACH, GRAM = 96, 192, 16
# Bytes that decide a trigger, from a string's start on, and bytes after a trigger that are its
# passage. All strings over the trigger hold them. Where another document has them too, they are
# shared; any 320 bytes in two documents have such a trigger in both.
DECIDED, PASSAGE = REACH + GRAM, 128
# Strings that are parsed at once; longer texts are parsed in pieces that overlap.
PIECE = 1 << 19
# Distinct surroundings that one task puts in order, and the widths by which larger
# dictionaries are split: strings that start in the same block of so many places.
PART, BLOCK = 4096, 16

_BYTES = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all 16-grams, by doubling."""
    value, width, factor = _BYTES[data], 1, np.array([_FACTOR])
    while width < GRAM:
        value = value[:-width] * factor + value[width:]
        factor, width = factor * factor, width * 2
    return value ^ (value >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` values in a row, from running minima of blocks."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def triggers(text: bytes) -> Iterator[tuple[int, int, int]]:
    """(trigger, first, last): the strings that start in first..last have this trigger.

    A string's trigger depends on its first DECIDED bytes only; shorter rests have none.
    """
    for start in range(0, len(text) - DECIDED + 1, PIECE):
        piece = np.frombuffer(text[start : start + PIECE + DECIDED - 1], np.uint8)
        strings = len(piece) - DECIDED + 1
        hashes = gram_hashes(piece)
        ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        least = (sliding_least(ranked, REACH)[:strings] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        marked = np.flatnonzero(hashes % np.uint64(EVERY) == 0)
        ends = np.append(marked, len(hashes) + REACH)
        following = np.repeat(ends, np.diff(ends, prepend=-1))[:strings]
        chosen = np.where(following < np.arange(strings) + REACH, following, least)
        edges = np.flatnonzero(np.diff(chosen)) + 1
        firsts, lasts = np.append(0, edges), np.append(edges, strings) - 1
        yield from zip(
            (chosen[firsts] + start).tolist(), (firsts + start).tolist(), (lasts + start).tolist()
        )


_COUNTED = "passage long, doc_id long, held long"
_PARSED = "passage long, doc_id long, text_hash long, at long, first long, last long, core long, whole long"


def parse(docs: DataFrame, wanted=None) -> DataFrame:
    """The triggers of all texts: passage (a hash), doc_id and held, 1 if a string of LENGTH bytes has the trigger.

    With a broadcast filter of passages, triggers with others are left out, and the rest come
    with text_hash, the places of the trigger and of its first and last string, and two hashes:
    core, of what all those strings hold, and whole, of all surroundings. These two are null
    where no string has the trigger.
    """

    def hashes(text: bytes, at: int, first: int, last: int) -> tuple[int | None, int | None]:
        if first > last:
            return None, None
        core = xxhash.xxh3_64_intdigest(text[at : at + LENGTH - REACH])
        return core - (1 << 63), xxhash.xxh3_64_intdigest(text[first : last + LENGTH], seed=(at - first) << 10 | (last - first)) - (1 << 63)

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        passages, ids, held = [], [], []
        digest = xxhash.xxh3_64_intdigest
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            data = (text or "").encode("utf-8", "surrogatepass")
            found = [t for t in triggers(data) if t[0] + PASSAGE <= len(data)]
            passages += [digest(data[at : at + PASSAGE]) for at, _, _ in found]
            ids += [doc_id] * len(found)
            held += [int(first <= len(data) - LENGTH) for _, first, _ in found]
            if len(ids) >= 1 << 16:
                yield _batch(_COUNTED, _signed(passages), ids, held)
                passages, ids, held = [], [], []
        yield _batch(_COUNTED, _signed(passages), ids, held)

    def pick(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        digest, out = xxhash.xxh3_64_intdigest, []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            data = (text or "").encode("utf-8", "surrogatepass")
            found = [t for t in triggers(data) if t[0] + PASSAGE <= len(data)]
            if not found:
                continue
            passages = _signed([digest(data[at : at + PASSAGE]) for at, _, _ in found])
            good = np.flatnonzero(may_hold(wanted.value, passages)).tolist()
            name = text_hash(data) if good else 0
            for k in good:
                at, first, last = found[k]
                last = min(last, len(data) - LENGTH)
                out.append((int(passages[k]), doc_id, name, at, first, last, *hashes(data, at, first, last)))
            if len(out) >= 1 << 15:
                yield _batch(_PARSED, *zip(*out))
                out = []
        yield _batch(_PARSED, *(zip(*out) if out else [()] * 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from count(batch) if wanted is None else pick(batch)

    return docs.select("doc_id", "text").mapInArrow(run, _COUNTED if wanted is None else _PARSED)


def _signed(digests: list[int]) -> np.ndarray:
    return np.array(digests, np.uint64).view(np.int64)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    """A batch of long columns with the names of a schema."""
    arrays = [pa.array(c if isinstance(c, np.ndarray) else list(c), pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in schema.split(", ")])


def text_hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _with_hash(docs: DataFrame, wanted) -> DataFrame:
    """doc_id, text_hash and data (the bytes) of the texts that a filter of hashes lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            names = np.array([text_hash(d) for d in data], np.int64)
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names), pa.array(data, pa.binary())], names=["doc_id", "text_hash", "data"]
            )
            yield out.filter(pa.array(may_hold(wanted.value, names)))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text_hash long, data binary")


def common_prefixes(rows: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each row and the one before; 0 for the first."""
    width = max(map(len, rows)) + 1
    table = np.zeros((len(rows), width), np.int16)
    for i, row in enumerate(rows):
        table[i, : len(row)] = np.frombuffer(row, np.uint8)
        table[i, len(row) :] = -1 - i % 2
    return np.append(0, (table[1:] != table[:-1]).argmax(axis=1))


def repeated_starts(
    before: list[bytes], after: list[bytes], low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(member, t) of the strings that two members of a dictionary share.

    Member i has the strings that start t bytes before its trigger for t in low[i]..high[i];
    ``before`` and ``after`` are its bytes on both sides of the trigger. The sorted texts
    after it are the order of the parse. A run of members whose texts before it agree in
    their last t bytes is one phrase suffix. Strings in order of phrase suffix, then parse,
    are compared with their neighbours by the shortest common prefix in between.
    """
    count = len(after)
    order = sorted(range(count), key=after.__getitem__)
    rank = np.empty(count, np.int64)
    rank[order] = np.arange(count)
    mins = [common_prefixes([after[i] for i in order])]
    while 1 << len(mins) <= count:
        step = 1 << (len(mins) - 1)
        mins.append(np.minimum(mins[-1][:-step], mins[-1][step:]))
    backward = [b[::-1] for b in before]
    suffix_order = sorted(range(count), key=backward.__getitem__)
    shared = common_prefixes([backward[i] for i in suffix_order])
    lengths = np.arange(low.min(), high.max() + 1)
    runs = np.empty((len(lengths), count), np.int64)
    runs[:, suffix_order] = np.cumsum(shared[None, :] < np.maximum(lengths, 0)[:, None], axis=1)
    place, member = np.nonzero((low[None, :] <= lengths[:, None]) & (lengths[:, None] <= high[None, :]))
    suffix = runs[place, member]
    sort = np.lexsort((rank[member], suffix, place))
    place, member, suffix = place[sort], member[sort], suffix[sort]
    ranks = rank[member]
    next_to = np.flatnonzero((place[1:] == place[:-1]) & (suffix[1:] == suffix[:-1]))
    a, b = ranks[next_to] + 1, ranks[next_to + 1] + 1
    level = np.log2(np.maximum(b - a, 1)).astype(np.int64)
    prefix = np.empty(len(next_to), np.int64)
    for k in np.unique(level):
        at = level == k
        prefix[at] = np.minimum(mins[k][a[at]], mins[k][b[at] - (1 << k)])
    good = next_to[prefix >= LENGTH - lengths[place[next_to]]]
    found = np.unique(np.concatenate([good, good + 1]))
    return member[found], lengths[place[found]]


def _order(group: pa.Table) -> pa.Table:
    """Repeated strings of one dictionary: per member, ranges low..high of t."""
    rows = {}
    for r in group.to_pylist():
        rows.setdefault((r["core"], r["whole"]), r)
    members = list(rows.values())
    names = ["core", "whole", "low", "high"]
    out: list[tuple] = []
    if len(members) > 1:
        low, high = (np.array([r[c] for r in members], np.int64) for c in ("low", "high"))
        data, origin = [r["data"] for r in members], [r["origin"] for r in members]
        member, t = repeated_starts(
            [d[:o] for d, o in zip(data, origin)], [d[o:] for d, o in zip(data, origin)], low, high
        )
        sort = np.lexsort((t, member))
        member, t = member[sort], t[sort]
        border = np.flatnonzero((np.diff(member) != 0) | (np.diff(t) != 1)) + 1
        starts, ends = np.append(0, border), np.append(border, len(t)) - 1
        if len(t):
            for s, e in zip(starts, ends):
                r = members[member[s]]
                out.append((r["core"], r["whole"], int(t[s]), int(t[e])))
    columns = zip(*out) if out else [()] * 4
    return pa.Table.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)


_RANGES = "core long, whole long, low long, high long"


def _shared(rows: DataFrame, width: int) -> DataFrame:
    """Split strings into blocks of ``width`` starts, with two hashes of what a block's strings share."""
    blocks = F.sequence(F.expr(f"low div {width}"), F.expr(f"high div {width}"))
    rows = rows.withColumn("block", F.explode(blocks))
    common = F.substring(
        "data",
        (F.col("origin") - F.col("block") * width + 1).cast("int"),
        F.lit(LENGTH - width + 1),
    )
    return rows.withColumns(
        {
            "low": F.greatest("low", F.col("block") * width),
            "high": F.least("high", F.col("block") * width + width - 1),
            "part1": F.xxhash64(F.lit(1), "block", common),
            "part2": F.xxhash64(F.lit(2), "block", common),
        }
    )


def dictionary_ranges(members: DataFrame, part: int = PART) -> DataFrame:
    """(core, whole, low, high): the repeated strings among distinct surroundings.

    Members are core, whole, low, high, origin (the trigger's place in data), data, and
    copies. Those of a core share a task up to ``part`` of them; beyond, blocks of strings
    with an equal common part do, and in blocks that are still larger every string is
    counted by itself.
    """
    sizes = members.groupBy("core").agg(F.count(F.lit(1)).alias("size"))
    sized = members.join(sizes, "core")
    small = sized.filter(F.col("size") <= part)
    columns = ["core", "whole", "low", "high", "origin", "data"]
    found = small.select(*columns).groupBy("core").applyInArrow(_order, _RANGES)
    large = sized.filter(F.col("size") > part).drop("size").repartition("core", "whole").dropDuplicates(["core", "whole"])
    large = staged(_shared(large, BLOCK), "repeats-blocks")
    blocks = large.groupBy("part1", "part2").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocked = large.join(blocks, ["part1", "part2"])
    ordered = (
        blocked.filter(F.col("size") <= part).select("part1", "part2", *columns).groupBy("part1", "part2").applyInArrow(_order, _RANGES)
    )
    single = staged(
        _shared(blocked.filter(F.col("size") > part).drop("size", "block", "part1", "part2"), 1).drop("data"), "repeats-strings"
    )
    equal = single.groupBy("part1", "part2").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    counted = single.join(equal, ["part1", "part2"]).select("core", "whole", "low", "high")
    return found.unionByName(ordered).unionByName(counted)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, stop, shared): spans that cover exactly the repeated bytes; they overlap.

    Rows without a span tell the number of triggers (shared) whose passage another doc_id has too.
    """
    document = F.coalesce("doc_id", F.lit(-1))
    passages = (
        parse(docs)
        .groupBy("passage")
        .agg((F.sum("held") > 1).alias("repeated"), (F.min(document) != F.max(document)).alias("shared"))
        .filter("repeated or shared")
    )
    passages = staged(passages, "repeats-passages")
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(key_filter(passages, F.col("passage")))
    met = staged(parse(docs, wanted).join(passages, "passage"), "repeats-met")
    shared = met.filter("shared").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("shared"))
    held = met.filter("core is not null").drop("passage", "repeated", "shared")
    cores = (
        held.groupBy("core")
        .agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b"))
        .filter("n > 1")
        .select("core", (F.col("a") != F.col("b")).alias("mixed"))
    )
    # Written down, so that the join has two plain sides and a hot core can be split.
    seen = staged(held.join(staged(cores, "repeats-cores"), "core"), "repeats-triggers")
    mixed = seen.filter("mixed")
    reach = {"low": F.col("at") - F.col("last"), "high": F.col("at") - F.col("first")}
    place = F.struct("doc_id", "text_hash", "at", "first", "last")
    classes = staged(
        mixed.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("place")), "repeats-dictionary"
    )
    names = spark.sparkContext.broadcast(key_filter(classes, F.col("place.text_hash")))
    texts = _with_hash(docs, names)
    chosen = classes.select("core", "whole", "place.*").alias("c")
    members = (
        chosen.join(texts.alias("t"), F.col("c.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("c.text_hash") == F.col("t.text_hash")))
        .withColumns(reach)
        .select(
            "core",
            "whole",
            "low",
            "high",
            F.col("high").alias("origin"),
            F.substring("data", (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first") + LENGTH).cast("int")).alias("data"),
        )
    )
    members = staged(members, "repeats-members")
    ranges = dictionary_ranges(members).groupBy("core", "whole").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    judged = classes.join(ranges, ["core", "whole"], "left").select("core", "whole", "copies", "ranges")
    # Written down, so that the next join has two plain sides and a hot class can be split.
    judged = staged(judged, "repeats-judged")
    alike = seen.filter("not mixed").select(
        "doc_id", "text_hash", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("stop")
    )
    all_of_it = F.array(F.struct((F.col("at") - F.col("last")).alias("low"), (F.col("at") - F.col("first")).alias("high")))
    some = (
        mixed.join(judged, ["core", "whole"])
        .select("doc_id", "text_hash", "at", F.explode(F.when(F.col("copies") > 1, all_of_it).otherwise(F.col("ranges"))).alias("r"))
        .select("doc_id", "text_hash", (F.col("at") - F.col("r.high")).alias("start"), (F.col("at") - F.col("r.low") + LENGTH).alias("stop"))
    )
    return alike.unionByName(some).unionByName(shared, allowMissingColumns=True)


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside of ``spans``, and the maximal runs that go."""
    runs: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(stop, runs[-1][1]))
        else:
            runs.append((start, stop))
    edges = [0, *[x for run in runs for x in run], len(text)]
    return b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)), runs


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (bytes), runs (removed spans) and shared of every row of ``docs``.

    ``shared`` counts triggers whose passage of PASSAGE bytes another document holds too; it tells
    of repeated passages that are too short to be removed, and of none in a text that has none.
    Documents are told apart by doc_id there. A null text counts as empty; texts shorter than LENGTH keep all. A null doc_id is
    carried. Rows that repeat are places of their own, so they repeat each other. Only
    doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = (
        repeated_spans(rows)
        .groupBy("doc_id", "text_hash")
        .agg(
            F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "stop"))).alias("spans"),
            F.coalesce(F.sum("shared"), F.lit(0)).alias("shared"),
        )
    )
    spans = staged(spans, "repeats-spans")
    names = docs.sparkSession.sparkContext.broadcast(key_filter(spans, F.col("text_hash")))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = "doc_id long, n_bytes long, kept binary, runs array<struct<start:long,stop:long>>, shared long"

    def batch_of(ids: pa.Array, sizes: list, kept: list, runs: list, shared: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(sizes, pa.int64()),
                pa.array(kept, pa.binary()),
                pa.array([[{"start": a, "stop": b} for a, b in r] for r in runs], run_type),
                pa.array(shared, pa.int64()),
            ],
            names=["doc_id", "n_bytes", "kept", "runs", "shared"],
        )

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            free = ~may_hold(names.value, np.array([text_hash(d) for d in data], np.int64))
            held = [d for d, f in zip(data, free) if f]
            yield batch_of(batch.column("doc_id").filter(pa.array(free)), list(map(len, held)), held, [[]] * len(held), [0] * len(held))

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("data").to_pylist()
            done = [cut(d, [(s["start"], s["stop"]) for s in f or []]) for d, f in zip(data, batch.column("spans").to_pylist())]
            yield batch_of(batch.column("doc_id"), list(map(len, data)), [k for k, _ in done], [r for _, r in done], batch.column("shared").fill_null(0))

    met = (
        _with_hash(rows, names)
        .alias("t")
        .join(spans.alias("s"), F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.text_hash") == F.col("s.text_hash")), "left")
        .select("t.doc_id", "data", "spans", "shared")
    )
    return rows.mapInArrow(untouched, schema).unionByName(met.mapInArrow(changed, schema))


def digest(result: DataFrame) -> DataFrame:
    """Sizes and hash of what is kept, and the number of passages shared with other documents."""
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return result.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("shared").alias("n_shared")
    )
