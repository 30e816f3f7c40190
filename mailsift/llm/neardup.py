"""Near-duplicates by MinHash and an LSH forest.

Each text's set of word shingles gets ``TREES`` signatures of ``LEVELS`` labels. Every
tree is one sort order of all signatures; texts whose signatures share a long prefix
stand next to each other there, and the nearest ones are candidates. How deep a prefix
they must share adapts to the region: where few texts share the first ``DEPTH`` labels,
all of them are candidates, and in dense regions the window around a text holds only
those with longer common prefixes. Candidates are confirmed on the full sets, links make
components, and texts with equal sets are one class from the start.

What the window leaves out is made up for: in every dense region that still holds more
than one component, texts of different components are compared, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import key_filter, let_through, staged
from mailsift.llm.graphs import components

# Trees and labels of 16 bits in each. Two texts of likeness 0.8 agree in the first
# five labels of some tree with probability 1 - (1 - 0.8**5)**32 = 0.999997.
TREES, LEVELS, DEPTH = 32, 8, 5
# Candidates on each side of a text in one tree.
WINDOW = 8
# Trees whose next neighbours are confirmed first; they join most of every group.
FIRST_TREES = 4
# Shingle hashes signed at once, and sorted rows that a task takes on average.
SIGN_ROWS, TASK_ROWS = 256, 1 << 16

# Texts of a dense region that one task compares with as many others.
BLOCK = 1024
# Standard deviations below the expected number of equal labels at which a pair of a
# dense region is passed over: a chance of 3 in a million at the very threshold.
SLACK = 4.5

_MULTIPLIERS = (np.random.default_rng(7).integers(0, 1 << 63, TREES * LEVELS, np.uint64) << np.uint64(1)) | np.uint64(1)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_words: dict[bytes, int] = {}


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``width`` words, ASCII letters in lower case.

    Fewer words are one shingle; without words the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.array([], np.uint64)
    if len(_words) > 1 << 20:
        _words.clear()
    for word in set(words):
        if word not in _words:
            _words[word] = xxhash.xxh3_64_intdigest(word)
    hashes = np.array([_words[w] for w in words], np.uint64)
    width = min(width, len(hashes))
    value = np.full(len(hashes) - width + 1, width, np.uint64)
    for i in range(width):
        value = (value ^ hashes[i : len(hashes) - width + 1 + i]) * _MIX[i % 4]
        value ^= value >> np.uint64(31)
    return np.unique(value)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The labels of all trees, packed: TREES rows of two int64."""
    least = np.full(TREES * LEVELS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), SIGN_ROWS):
        least = np.minimum(least, (hashes[i : i + SIGN_ROWS, None] * _MULTIPLIERS).min(axis=0))
    labels = ((least * _MIX[0]) >> np.uint64(48)).astype(">u2")
    return np.frombuffer(labels.tobytes(), ">i8").astype(np.int64).reshape(TREES, 2)


_SIGNED = "doc_id long, n_shingles long, key binary, signature array<struct<a:long,b:long>>"


def signed(docs: DataFrame, width: int) -> DataFrame:
    """Size, key (a 128-bit hash of the set) and signature of every text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, labels = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, width)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                labels.append(signature(found) if len(found) else np.zeros((0, 2), np.int64))
            offsets = np.append(0, np.cumsum([len(x) for x in labels])).astype(np.int32)
            flat = np.concatenate([*labels, np.zeros((0, 2), np.int64)])
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pairs),
                ],
                names=["doc_id", "n_shingles", "key", "signature"],
            )

    return docs.mapInArrow(run, _SIGNED)


_FOUND = "kind int, x long, y long, tree int, a long, b long, gap int"
_FIELDS = ("kind", "x", "y", "tree", "a", "b", "gap")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within the window of sorted rows (kind 0), and a partition's last and first rows.

    Rows near the border of partition p come out with kind 1 (its last rows) under number
    p and with kind 2 (the next one's first rows) under the same number.
    """
    part = TaskContext.get().partitionId()
    types = dict(zip(_FIELDS, (pa.int32(), *[pa.int64()] * 2, pa.int32(), *[pa.int64()] * 2, pa.int32())))

    def rows(count: int, **columns) -> pa.RecordBatch:
        zero = np.zeros(count, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.broadcast_to(columns.get(c, zero), count).astype(np.int64)).cast(t) for c, t in types.items()],
            names=list(types),
        )

    def border(held: np.ndarray, kind: int, number: int) -> pa.RecordBatch:
        return rows(len(held), kind=kind, x=number, tree=held[:, 0], a=held[:, 1], b=held[:, 2], y=held[:, 3])

    held, heads = np.zeros((0, 4), np.int64), 0
    for batch in batches:
        new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tree", "a", "b", "doc_id")], axis=1)
        if heads < WINDOW:
            yield border(new[: WINDOW - heads], 2, part - 1)
            heads += len(new[: WINDOW - heads])
        table, old = np.concatenate([held, new]), len(held)
        for gap in range(1, WINDOW + 1):
            first, second = table[:-gap], table[gap:]
            near = (first[:, 0] == second[:, 0]) & shares_prefix(first[:, 1:3], second[:, 1:3])
            near &= (first[:, 3] != second[:, 3]) & (np.arange(len(second)) + gap >= old)
            x, y = first[near, 3], second[near, 3]
            if len(x):
                yield rows(len(x), x=np.minimum(x, y), y=np.maximum(x, y), tree=first[near, 0], gap=gap)
        held = table[-WINDOW:]
    yield border(held, 1, part)


def shares_prefix(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether two packed signatures agree in their first DEPTH labels."""
    return (first[:, 0] == second[:, 0]) & ((first[:, 1] ^ second[:, 1]) >> (16 * (LEVELS - DEPTH)) == 0)


def candidates(nodes: DataFrame) -> DataFrame:
    """Distinct candidate pairs x < y of ``nodes`` (doc_id, signature); ``first`` marks the nearest."""
    rows = nodes.select("doc_id", F.posexplode("signature").alias("tree", "s")).select("tree", "s.a", "s.b", "doc_id")
    parts = max(1, min(10_000, nodes.count() * TREES // TASK_ROWS))
    order = ["tree", "a", "b", "doc_id"]
    found = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, _FOUND)
    found = staged(found, "forest-neighbours")
    tail = found.filter("kind = 1").groupBy("x").agg(F.collect_list(F.struct("tree", "a", "b", "y")).alias("tail"))
    head = found.filter("kind = 2").groupBy("x").agg(F.collect_list(F.struct("tree", "a", "b", "y")).alias("head"))
    same = " and ".join(
        ["t.tree = h.tree", "t.a = h.a", f"shiftright(t.b ^ h.b, {16 * (LEVELS - DEPTH)}) = 0", "t.y <> h.y"]
    )
    across = (
        tail.join(head, "x")
        .select(F.explode("tail").alias("t"), "head")
        .select("t", F.explode("head").alias("h"))
        .filter(same)
        .select(F.least("t.y", "h.y").alias("x"), F.greatest("t.y", "h.y").alias("y"), F.lit(True).alias("first"))
    )
    inside = found.filter("kind = 0").select("x", "y", ((F.col("gap") == 1) & (F.col("tree") < FIRST_TREES)).alias("first"))
    return inside.unionByName(across).groupBy("x", "y").agg(F.max("first").alias("first"))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, likeness: int) -> DataFrame:
    """The pairs whose full sets have ``likeness`` hundredths of their union in common, or more."""
    joined = (
        texts.select(F.col("doc_id").alias("x"), F.col("text").alias("text_x"))
        .join(pairs.select("x", "y"), "x")
        .join(texts.select(F.col("doc_id").alias("y"), F.col("text").alias("text_y")), "y")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[str, np.ndarray] = {}
            good = []
            for first, second in zip(batch.column("text_x").to_pylist(), batch.column("text_y").to_pylist()):
                for text in (first, second):
                    if text not in sets:
                        sets[text] = shingles(text, width)
                a, b = sets[first], sets[second]
                common = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * common >= likeness * (len(a) + len(b) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(
                pa.array(good, pa.bool_())
            )

    return joined.select("x", "y", "text_x", "text_y").mapInArrow(run, "x long, y long")


def dense_links(nodes: DataFrame, part: DataFrame, texts: DataFrame, width: int, likeness: int) -> DataFrame:
    """Links between components inside dense regions: those that the window does not cover.

    ``part`` is (node, root) so far. The members of a region's largest component meet all
    others, and these each other; every group is one block of each side. Nothing but
    confirmed links leaves a task.
    """
    known = part.select(F.col("node").alias("doc_id"), "root")
    region = ["tree", "a", "prefix"]
    rows = (
        nodes.join(known, "doc_id", "left")
        .select("doc_id", F.coalesce("root", "doc_id").alias("component"), F.posexplode("signature").alias("tree", "s"))
        .select("doc_id", "component", "tree", "s.a", F.shiftright("s.b", 16 * (LEVELS - DEPTH)).alias("prefix"))
    )
    dense = (
        rows.groupBy(*region, "component")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*region)
        .agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("components"),
            F.max("n").alias("largest"),
            F.max_by("component", F.struct("n", "component")).alias("main"),
        )
        .filter((F.col("n") > WINDOW + 1) & (F.col("components") > 1))
    )
    dense = staged(dense, "forest-dense")
    mains = F.ceil(F.col("largest") / BLOCK).cast("int")
    others = F.ceil((F.col("n") - F.col("largest")) / BLOCK).cast("int")
    members = rows.join(dense, region).withColumns(
        {"is_main": F.col("component") == F.col("main"), "mains": mains, "others": others}
    )
    slot = F.pmod(F.xxhash64("doc_id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    members = members.withColumn("slot", slot)
    block = lambda x, main, y: F.struct(x.alias("one"), F.lit(main).alias("with_main"), y.alias("two"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.col("slot")
    of_main = F.transform(upto("others"), lambda j: block(j, True, own))
    of_other = F.concat(
        F.transform(upto("mains"), lambda j: block(own, True, j)),
        F.transform(upto("others"), lambda j: block(F.least(own, j), False, F.greatest(own, j))),
    )
    placed = members.select(
        "doc_id", "component", "is_main", *region, F.explode(F.when(F.col("is_main"), of_main).otherwise(of_other)).alias("at")
    )
    least = TREES * LEVELS * likeness / 100
    least -= SLACK * (least * (1 - likeness / 100)) ** 0.5

    def compare(group: pa.Table) -> pa.Table:
        ids, components = group.column("doc_id").to_pylist(), group.column("component").to_pylist()
        main = np.array(group.column("is_main").to_pylist(), bool)
        sets = [shingles(t, width) for t in group.column("text").to_pylist()]
        labels = np.stack([signature(x).view(np.uint16).ravel() for x in sets])
        sizes = np.array([len(x) for x in sets])
        root = {c: c for c in components}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        found: list[tuple[int, int]] = []
        either = main.any()
        for i in np.flatnonzero(~main):
            against = np.flatnonzero(main) if either else np.arange(i + 1, len(ids))
            near = (labels[against] == labels[i]).sum(axis=1) >= least
            near &= 100 * np.minimum(sizes[against], sizes[i]) >= likeness * np.maximum(sizes[against], sizes[i])
            for j in against[near]:
                x, y = find(components[i]), find(components[j])
                if x != y:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= likeness * (sizes[i] + sizes[j] - common):
                        root[x] = y
                        found.append((ids[i], ids[j]))
        columns = zip(*found) if found else [(), ()]
        return pa.Table.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["x", "y"])

    met = placed.join(texts, "doc_id").select(*region, "at.*", "doc_id", "component", "is_main", "text")
    return met.groupBy(*region, "one", "with_main", "two").applyInArrow(compare, "x long, y long")


def near_duplicates(docs: DataFrame, width: int = 5, likeness: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Null, empty and wordless texts have empty sets and are linked with nothing. Texts of
    equal sets are linked. Rows of one doc_id are one node, linked when any of their texts
    is. A row without a doc_id is linked with nothing: its component is null and it is kept.
    Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = staged(signed(rows, width), "forest-signatures")
    classes = sets.dropna(subset=["key", "doc_id"]).groupBy("key").agg(F.min("doc_id").alias("rep"))
    classes = staged(classes, "forest-classes")
    nodes = sets.join(classes.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"]).select("doc_id", "signature")
    pairs = staged(candidates(nodes), "forest-pairs")
    members = pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    members = staged(members, "forest-members")
    likely = let_through(rows, "doc_id", key_filter(members, F.col("doc_id")))
    texts = staged(likely.join(members, "doc_id", "left_semi").distinct(), "forest-texts")
    links = staged(confirmed(pairs.filter("first"), texts, width, likeness), "forest-links")
    # Rows of one id with several texts tie the classes they stand for together.
    ties = sets.join(classes, "key").filter("doc_id <> rep").select(F.col("rep").alias("x"), F.col("doc_id").alias("y"))
    own = classes.select(F.col("rep").alias("y")).distinct()
    ties = ties.join(own, "y", "left_semi").select("x", "y")
    links = links.unionByName(ties)
    part = staged(components(links), "forest-components")
    root = lambda c: part.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    rest = (
        pairs.filter("not first")
        .join(root("x"), "x", "left")
        .join(root("y"), "y", "left")
        .filter(F.coalesce("root_x", "x") != F.coalesce("root_y", "y"))
        .select("x", "y")
    )
    # What holds together already goes on as links to its root.
    whole = lambda p: p.select(F.col("node").alias("x"), F.col("root").alias("y"))
    part = staged(components(confirmed(rest, texts, width, likeness).unionByName(whole(part))), "forest-components")
    part = components(dense_links(nodes, part, texts, width, likeness).unionByName(whole(part)))
    named = classes.join(part.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", F.coalesce("root", "rep").alias("component_id")
    )
    placed = sets.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return placed.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
