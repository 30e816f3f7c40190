"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample and broadcast; every vector is then indexed in
one leaf of each tree. A query walks all trees with one shared priority queue: of all
branches not taken so far, in any tree, it follows the one whose border is closest.
How many leaves a query looks into is found anew for every table: some queries are
answered exactly over all rows, and the leaves are counted that give their true neighbours.
Leaves meet their queries in co-groups of bounded size, where inner products are exact.

Largest inner products become nearest points by one more component that brings all
vectors to the same length; queries have 0 there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.common import staged

# Trees, vectors in a leaf on average, and leaves that one query looks into at least.
TREES, LEAF, PROBES = 12, 512, 112
# Share of the true neighbours to find, and the queries it is measured on. It is above the
# wanted 0.9 by more than the error of a mean over so many queries.
RECALL, CALIBRATION = 0.95, 128
# Vectors that the trees are fitted on, about; a leaf holds at least 8 of them.
SAMPLE, SAMPLE_LEAF = 1 << 16, 8
# Vectors of a leaf that one task meets queries with; larger leaves have several parts.
PART = 4096
SEED = 11


@dataclass(frozen=True)
class Tree:
    """Inner nodes with unit normals, offsets and two children; child -i-1 is leaf i."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaf_parts: np.ndarray


def grow(points: np.ndarray, leaf: int, scale: float, rng: np.random.Generator) -> Tree:
    """Split by planes between two random points, at the median, down to ``leaf`` points."""
    normals, offsets, children, sizes = [], [], [], []

    def split(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            for _ in range(3):
                a, b = points[rng.choice(rows, 2, replace=False)]
                length = np.linalg.norm(a - b)
                if length == 0:
                    continue
                normal = ((a - b) / length).astype(np.float32)
                along = points[rows] @ normal
                offset = np.float32(np.median(along))
                right = along >= offset
                if right.any() and not right.all():
                    at = len(normals)
                    normals.append(normal)
                    offsets.append(offset)
                    children.append([0, 0])
                    children[at] = [split(rows[~right]), split(rows[right])]
                    return at
        sizes.append(len(rows))
        return -len(sizes)

    split(np.arange(len(points)))
    parts = np.maximum(1, np.ceil(np.array(sizes) * scale / PART)).astype(np.int64)
    shape = (len(normals), points.shape[1])
    return Tree(
        np.array(normals, np.float32).reshape(shape),
        np.array(offsets, np.float32),
        np.array(children, np.int64).reshape(-1, 2),
        parts,
    )


def leaves_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf of every point."""
    at = np.zeros(len(points), np.int64) if len(tree.normals) else np.full(len(points), -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        node = at[inner]
        side = np.einsum("ij,ij->i", points[inner], tree.normals[node]) >= tree.offsets[node]
        at[inner] = tree.children[node, side.astype(int)]
    return -at - 1


def search(forest: list[Tree], query: np.ndarray, probes: int) -> list[tuple[int, int]]:
    """Up to ``probes`` (tree, leaf), nearest borders first over all trees."""
    queue = [(0.0, t, 0 if len(tree.normals) else -1) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    found = []
    while queue and len(found) < probes:
        margin, t, at = heapq.heappop(queue)
        tree = forest[t]
        while at >= 0:
            distance = float(query @ tree.normals[at] - tree.offsets[at])
            near = int(distance >= 0)
            heapq.heappush(queue, (max(margin, abs(distance)), t, int(tree.children[at, 1 - near])))
            at = int(tree.children[at, near])
        found.append((t, -at - 1))
    return found


def found_after(forest: list[Tree], query: np.ndarray, points: np.ndarray, most: int) -> np.ndarray:
    """How many leaves ``search`` looks into until each point is met; most + 1 for later ones."""
    holds: dict[tuple[int, int], list[int]] = {}
    for t, tree in enumerate(forest):
        for i, leaf in enumerate(leaves_of(tree, points)):
            holds.setdefault((t, int(leaf)), []).append(i)
    after = np.full(len(points), most + 1)
    for n, visited in enumerate(search(forest, query, most), 1):
        for i in holds.get(visited, ()):
            after[i] = min(after[i], n)
    return after


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column, of equal lengths, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def _list(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.astype(np.float32).ravel()))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, with two hashes of the embedding.

    Null, empty and zero vectors, those with null or non-finite components, and rows
    without an id are left out, as are vectors that are not of the most frequent length.
    """
    v = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<float>").alias("embedding"))
    rows = rows.filter("vec_id is not null and embedding is not null")
    rows = rows.filter(~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
    widths = rows.groupBy(F.size(v).alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = widths[0]["width"] if widths else 0
    return rows.filter(F.size(v) == width).withColumns(
        {"k1": F.xxhash64(v), "k2": F.xxhash64(F.lit(SEED), v)}
    )


def true_points(points: DataFrame, asked: np.ndarray, most: int) -> DataFrame:
    """query (its row in ``asked``), n, point, ids and embedding of the ``most`` best points, exactly."""
    shared = points.sparkSession.sparkContext.broadcast(asked.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(shared.value), 0), 0.0), np.zeros((len(shared.value), 0), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                scores = shared.value @ _matrix(part.column("embedding")).astype(np.float64).T
                ids = np.broadcast_to(part.column("point").to_numpy(), scores.shape)
                scores, ids = np.concatenate([best[0], scores], axis=1), np.concatenate([best[1], ids], axis=1)
                kept = np.argsort(-scores, axis=1, kind="stable")[:, :most]
                best = np.take_along_axis(scores, kept, axis=1), np.take_along_axis(ids, kept, axis=1)
        query = np.repeat(np.arange(len(best[0])), best[0].shape[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(best[1].ravel()), pa.array(best[0].ravel())], names=["query", "point", "score"]
        )

    order = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    found = points.select("point", "embedding").mapInArrow(run, "query long, point long, score double")
    found = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    return found.select("query", "n", "point").join(points.select("point", "ids", "embedding"), "point")


def probes_needed(
    points: DataFrame, asked: DataFrame, forest: list[Tree], radius: float, k: int, least: int, most: int
) -> int:
    """Leaves to look into, from ``least``, so that RECALL of the true neighbours are found.

    Measured on CALIBRATION of the points ``asked``, as far as ``most`` leaves; above ``least``
    and from ``most`` on, so many are needed that another way is better.
    """
    limit = max(least, most)
    chosen = asked.orderBy("k1", "k2").limit(CALIBRATION).select("point", "embedding").toArrow()
    if not chosen.num_rows:
        return least
    queries, own = _matrix(chosen.column("embedding").combine_chunks()), chosen.column("point").to_numpy()
    truth: dict[int, list] = {}
    for r in true_points(points, queries, k + 1).orderBy("query", "n").toArrow().to_pylist():
        truth.setdefault(r["query"], []).append(r)
    raised = np.concatenate([queries, np.zeros((len(queries), 1), np.float32)], axis=1)
    found = np.zeros(limit + 2)
    for q, rows in truth.items():
        # The neighbours are ids: a point counts by those of its ids that are among the first k.
        sizes = np.array([len(r["ids"]) - (r["point"] == own[q]) for r in rows])
        weight = np.clip(k - (np.cumsum(sizes) - sizes), 0, sizes)
        if weight.sum():
            after = found_after(forest, raised[q], lifted(np.array([r["embedding"] for r in rows]), radius), limit)
            np.add.at(found, after, weight / weight.sum())
    if not found.any():
        return least
    return max(least, int(np.flatnonzero(np.cumsum(found) >= (RECALL - 1e-9) * found.sum())[0]))


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, trees: int = TREES, leaf: int = LEAF, probes: int = PROBES
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` largest inner products found per query.

    Queries look into ``probes`` leaves at least, and into as many as find RECALL of the true
    neighbours; where that takes as many leaves as one tree has, they look into all of that
    tree, which is exact. Queries are the rows whose vec_id is divisible by ``every``; a query's own row is no
    candidate, other rows with an equal vector are. Ties go to the smaller vec_id. Equal
    vectors are searched once; of each vector, the k + 1 smallest ids can be in a result,
    so no more are carried. An id that repeats with another vector counts with both; rows
    that repeat as they are count once. Only vec_id and embedding are read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    same = Window.partitionBy("k1", "k2").orderBy("vec_id")
    points = (
        rows.withColumn("n", F.dense_rank().over(same))
        .filter(F.col("n") <= k + 1)
        .groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))
        .withColumn("point", F.monotonically_increasing_id())
    )
    points = staged(points, "forest-points")
    count = points.count()
    share = F.pmod("k1", F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(count, 1)))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    radius = points.agg(F.max(length)).first()[0] or 0.0
    sample = points.filter(share).orderBy("k1", "k2").select("embedding").toArrow()
    fitted = _matrix(sample.column("embedding").combine_chunks())
    rng = np.random.default_rng(SEED)
    scale = count / max(len(fitted), 1)
    size = max(SAMPLE_LEAF, int(leaf / scale)) if count else leaf
    forest = [grow(lifted(fitted, radius), size, scale, rng) for _ in range(trees)]
    queries = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "k1", "k2").distinct()
    queries = queries.join(points.select("k1", "k2", "point"), ["k1", "k2"]).select(
        F.col("vec_id").alias("query_id"), F.col("point").alias("query")
    )
    queries = staged(queries, "forest-queries")
    asked = points.join(queries.select(F.col("query").alias("point")).distinct(), "point", "left_semi")
    small = min(forest, key=lambda tree: len(tree.leaf_parts))
    needed = probes_needed(points, asked, forest, radius, k, probes, len(small.leaf_parts))
    if needed > probes and needed >= len(small.leaf_parts):
        forest = [small]
    probes = needed
    shared = spark.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix, ids = _matrix(batch.column("embedding")), batch.column("point").to_numpy()
            raised = lifted(matrix, radius)
            for t, tree in enumerate(shared.value):
                at = leaves_of(tree, raised)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), t)), pa.array(at), pa.array(ids % tree.leaf_parts[at]), pa.array(ids), _list(matrix)],
                    names=["tree", "leaf", "part", "point", "embedding"],
                )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix, ids = _matrix(batch.column("embedding")), batch.column("point").to_numpy()
            raised = np.concatenate([matrix, np.zeros((len(matrix), 1), np.float32)], axis=1)
            for start in range(0, len(ids), 64):
                out = [
                    (t, leaf_no, part, row)
                    for row in range(start, min(start + 64, len(ids)))
                    for t, leaf_no in search(shared.value, raised[row], probes)
                    for part in range(shared.value[t].leaf_parts[leaf_no])
                ]
                table = np.array(out, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(table[:, i]) for i in range(3)], pa.array(ids[table[:, 3]]), _list(matrix[table[:, 3]])],
                    names=["tree", "leaf", "part", "point", "embedding"],
                )

    schema = "tree long, leaf long, part long, point long, embedding array<float>"
    placed = points.select("point", "embedding").mapInArrow(place, schema)
    asked = asked.select("point", "embedding").mapInArrow(ask, schema)

    def meet(indexed: pa.Table, asking: pa.Table) -> pa.Table:
        names = ["query", "point", "score"]
        if not indexed.num_rows or not asking.num_rows:
            empty = [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())]
            return pa.Table.from_arrays(empty, names=names)
        data = _matrix(indexed.column("embedding").combine_chunks()).astype(np.float64)
        ids = indexed.column("point").to_numpy()
        query_ids = asking.column("point").to_numpy()
        against = _matrix(asking.column("embedding").combine_chunks()).astype(np.float64)
        found = []
        for start in range(0, len(against), 256):
            block = against[start : start + 256]
            scores = block @ data.T
            most = min(k + 1, scores.shape[1])
            # Everything within rounding of the last place is kept, so ties are settled exactly later.
            last = np.partition(scores, -most, axis=1)[:, -most]
            found.append(np.argwhere(scores >= (last - 1e-9 * (1 + np.abs(last)))[:, None]) + [start, 0])
        pairs = np.concatenate(found)
        exact = (against[pairs[:, 0]] * data[pairs[:, 1]]).sum(axis=1)
        return pa.Table.from_arrays(
            [pa.array(query_ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]]), pa.array(exact)], names=names
        )

    keys = ("tree", "leaf", "part")
    met = (
        placed.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInArrow(meet, "query long, point long, score double")
        .groupBy("query", "point")
        .agg(F.max("score").alias("score"))
        .join(points.select("point", F.col("ids")[0].alias("least")), "point")
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    top = met.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).select("query", "point", "score")
    top = staged(top.join(points.select("point", "ids"), "point").select("query", "score", "ids"), "forest-top")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        queries.join(top, "query")
        .select("query_id", "score", F.explode("ids").alias("vec_id"))
        .filter("vec_id <> query_id")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def lifted(matrix: np.ndarray, radius: float) -> np.ndarray:
    """Rows with one more component that gives all of them the length ``radius``."""
    squares = (matrix.astype(np.float64) ** 2).sum(axis=1)
    extra = np.sqrt(np.maximum(0.0, radius**2 - squares)).astype(np.float32)
    return np.concatenate([matrix.astype(np.float32), extra[:, None]], axis=1)
