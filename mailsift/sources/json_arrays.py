"""Arrays of objects in JSON files of any size, read in pieces.

A JSON document cannot be split at an arbitrary place, because only what comes before tells
whether a place lies in a string and how deep it is nested. Both are running sums, though: of
quotation marks, whose parity tells strings, and of brackets. So files are read as Spark reads
text, split into tasks, with ``}`` for a line's end. Each piece is summed up for both cases, inside
and outside of a string; the sums of a split's pieces, and of a file's splits, give the true
case and depth of every piece. Pieces up to a bracket that closes an element are that element.

A file of at most ``SMALL`` bytes lies in one split anyway. There the same sums run over its bytes,
in one pass and without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailsift.ranking import computed_once
from mailsift.session import durable

SPLIT = ["file", "block"]
# Bytes of a file that is read whole; larger files are split.
SMALL = 4 << 20
# Kinds of the bytes that matter, 0 for others.
_KINDS = np.zeros(256, np.int8)
_KINDS[list(b'"\\{}[]')] = range(1, 7)
QUOTE, ESCAPE, OPEN, CLOSE, OPEN_LIST, CLOSE_LIST = range(1, 7)


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, length, content) of the files, listed once; contents are read only where they are used."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.col("_metadata.file_path").alias("file"), "length", "content")


def _closings(data: bytes, base: int) -> tuple[list[int], bool]:
    """Places of the brackets that close elements, and whether quotes and brackets of the file fit."""
    codes = _KINDS[np.frombuffer(data, np.uint8)]
    at = np.flatnonzero(codes)
    kind = codes[at]
    slashes = at[kind == ESCAPE]
    if len(slashes):
        # Every second backslash of a run is escaped itself; the others escape what follows.
        number = np.arange(len(slashes))
        first = np.maximum.accumulate(np.where(np.diff(slashes, prepend=-2) > 1, number, 0))
        escaped = slashes[(number - first) % 2 == 0] + 1
        keep = (kind != ESCAPE) & (~np.isin(at, escaped) | (kind == CLOSE))
        at, kind = at[keep], kind[keep]
    quotes = np.cumsum(kind == QUOTE)
    outside = (quotes % 2 == 0) & (kind != QUOTE)
    at, kind = at[outside], kind[outside]
    arrays = np.cumsum((kind == OPEN_LIST).astype(np.int64) - (kind == CLOSE_LIST))
    depth = arrays + np.cumsum((kind == OPEN).astype(np.int64) - (kind == CLOSE))
    sound = (not len(depth) or depth[-1] == 0) and (not len(quotes) or quotes[-1] % 2 == 0)
    return at[(kind == CLOSE) & (depth == base) & (arrays == 1)].tolist(), bool(sound)


def _scan(field: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(file, content) to (file, pos, text): the objects of each file, and at -1 what is around them."""
    name = b"" if field is None else re.escape(field.encode())
    head = re.compile(rb"\s*\[\s*" if field is None else rb'(?s)\s*\{.*?"' + name + rb'"\s*:\s*\[\s*')
    comma, rest = re.compile(rb"\s*,\s*"), re.compile(rb"\s*\[\s*\]\s*\Z" if field is None else rb"\s*\{")

    def objects(file: str, data: bytes) -> list[bytes]:
        ends, sound = _closings(data, 1 if field is None else 2)
        found, start, around = [], 0, b""
        for end in ends:
            opening = (comma if start else head).match(data, start, end)
            if not sound or not opening or data[opening.end() : opening.end() + 1] != b"{":
                raise ValueError(f"not a JSON array of objects: {file}")
            if not start:
                around = opening.group()
            found.append(data[opening.end() : end + 1])
            start = end + 1
        around += data[start:]
        if not sound or not rest.match(around):
            raise ValueError(f"not a JSON array: {file}")
        return [around, *found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content")):
                data = data.as_py()
                if data:
                    found = objects(file, data)
                    texts = pa.array(found, pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file] * len(found)),
                            pa.array(np.arange(-1, len(found) - 1)),
                            pa.Array.from_buffers(pa.string(), len(found), texts.buffers()),
                        ],
                        names=["file", "pos", "text"],
                    )

    return run


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def _brackets(outside: Column) -> tuple[Column, Column]:
    """Depth gained over text outside of strings, without the bracket that ends a piece, and that of arrays alone."""
    arrays = _count(outside, "[") - _count(outside, "]")
    return _count(outside, "{") + arrays, arrays


def _pieces(spark: SparkSession, paths: list[str], above: int) -> DataFrame:
    """file, size, block, line, value, q (quotation marks, modulo 2), and d0, d1 (depth gained) and a0, a1 (that of
    arrays) if the piece starts outside or inside of a string."""
    source = spark.read.option("lineSep", "}").text(paths)
    pieces = source.filter(F.col("_metadata.file_size") > above).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    inner = F.regexp_replace(bare, r'^[^"]*+(?:"|$)', "")
    strings = r'"[^"]*+(?:"|$)'
    odd = _count(bare, '"') % 2
    d0, a0 = _brackets(F.regexp_replace(bare, strings, ""))
    d1, a1 = _brackets(F.regexp_replace(inner, strings, ""))
    # The bracket at the end counts if it is outside of a string.
    end = {"d0": d0 - F.when(odd == 0, 1).otherwise(0), "d1": d1 - F.when(odd == 1, 1).otherwise(0)}
    return pieces.withColumns({"q": odd, "a0": a0, "a1": a1, **end})


def _placed(spark: SparkSession, paths: list[str], base: int, above: int) -> DataFrame:
    """Pieces with place (its number, over splits), element (its number), closing, and whether the file is well-formed.

    ``base`` is the depth of the array's brackets; an element closes where the depth falls back to it.
    """
    upto = Window.partitionBy(*SPLIT).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    pieces = _pieces(spark, paths, above)
    # Parity in front of the piece, relative to the split's start, and depth behind it for both starts.
    pieces = pieces.withColumn("p", (F.sum("q").over(upto) - F.col("q")) % 2)
    for start in (0, 1):
        for name, kind in (("depth", "d"), ("arrays", "a")):
            gain = F.when(F.col("p") == start, F.col(f"{kind}0")).otherwise(F.col(f"{kind}1"))
            pieces = pieces.withColumn(f"{name}{start}", F.sum(gain).over(upto))
    order = F.row_number().over(Window.partitionBy(*SPLIT).orderBy("line"))
    # Written down, so that the text is read once; what follows reads narrow columns, and at last the pieces.
    pieces = durable(pieces.withColumn("at", order), "json-pieces")
    ends = pieces.groupBy(*SPLIT).agg(
        F.sum("q").alias("quotes"),
        F.max_by("depth0", "at").alias("gain0"),
        F.max_by("depth1", "at").alias("gain1"),
        F.max_by("arrays0", "at").alias("list0"),
        F.max_by("arrays1", "at").alias("list1"),
        F.sum(F.octet_length("value")).alias("octets"),
        F.count(F.lit(1)).alias("rows"),
        F.first("size").alias("size"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("file")
    ends = ends.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    of_start = lambda name: F.when(F.col("odd") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    ends = ends.withColumns({"gain": of_start("gain"), "list": of_start("list")})
    # The last piece of a file need not end with a bracket; the file's size tells.
    closed = F.col("size") - F.sum("octets").over(every) - F.sum("rows").over(every) + 1
    final = F.sum("gain").over(every) + F.when(closed == 1, 0).otherwise(1)
    splits = ends.select(
        *SPLIT,
        "odd",
        F.coalesce(F.sum("gain").over(before), F.lit(0)).alias("depth"),
        F.coalesce(F.sum("list").over(before), F.lit(0)).alias("arrays"),
        (closed == 1).alias("closed"),
        ((final == 0) & (F.sum("quotes").over(every) % 2 == 0)).alias("sound"),
    )
    met = pieces.join(splits, SPLIT)
    at_base = (F.col("depth") + of_start("depth") == base) & (F.col("arrays") + of_start("arrays") == 1)
    outside = (F.col("p") + F.col("q") + F.col("odd")) % 2 == 0
    # Only objects that lie right in an array of that depth close to it; a piece closes one at most.
    return met.select(
        "file", "block", "at", "value", "closed", "sound", (outside & at_base).alias("closing")
    )


def elements(
    spark: SparkSession, paths: list[str], field: str | None = None, files: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """((file, pos, text) of an array's objects, (file, text) of what is around them).

    The array is the whole file, or the value of ``field`` in the file's object. What is around
    holds the other fields and an empty array. A file that is cut off, an array that holds
    anything but objects, more than one array in a file of one, or a second array of objects
    beside ``field``, is an error as soon as its row is read. Files are in any order; ``pos``
    counts from 0 in each. A file of no bytes has no rows. ``files`` are those of ``listed``
    that are wanted, all by default.
    """
    objects, around, large = _elements(spark, paths, field, files)
    return objects, around.unionByName(large) if large else around


def checked_objects(
    spark: SparkSession, paths: list[str], field: str | None = None, files: DataFrame | None = None
) -> DataFrame:
    """The objects of ``elements``; a file that is not well-formed is an error here, each file being read once."""
    objects, _, large = _elements(spark, paths, field, files)
    if large is None:
        return objects
    # No rows, but an error where a large file is not one well-formed array.
    complaints = computed_once(large.filter(F.length("text") < 0).select("file"))
    return objects.unionByName(complaints, allowMissingColumns=True)


def _elements(spark: SparkSession, paths: list[str], field: str | None, files: DataFrame | None) -> tuple:
    """Objects, what is around those of small files, and what is around those of large files, if there are any."""
    files = listed(spark, paths) if files is None else files
    small = files.filter(F.col("length") <= SMALL).select("file", "content")
    found = small.mapInArrow(_scan(field), "file string, pos long, text string")
    objects = computed_once(found.filter("pos >= 0"))
    around = found.filter("pos < 0").select("file", "text")
    large = files.filter(F.col("length") > SMALL).select("file")
    if large.isEmpty():
        return objects, around, None
    more, beside = _split_elements(spark, paths, field)
    return objects.unionByName(more.join(large, "file", "left_semi")), around, beside.join(large, "file", "left_semi")


def _split_elements(spark: SparkSession, paths: list[str], field: str | None) -> tuple[DataFrame, DataFrame]:
    """``elements`` of the large files alone, in many tasks."""
    placed = _placed(spark, paths, 1 if field is None else 2, SMALL)
    earlier = Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.count_if("closing").over(earlier), F.lit(0)))
    totals = placed.groupBy(*SPLIT).agg(F.count_if("closing").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *SPLIT,
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.sum("n").over(Window.partitionBy("file")).alias("all"),
    )
    numbered = placed.join(totals, SPLIT).withColumn("pos", F.col("first") + F.col("inside"))
    parts = F.sort_array(F.collect_list(F.struct("block", "at", "value")))

    def grouped(pieces: DataFrame) -> DataFrame:
        return pieces.groupBy("file", "pos").agg(
            F.array_join(F.transform(parts, lambda p: p["value"]), "}").alias("text"),
            F.first("sound").alias("sound"),
            F.first("closed").alias("closed"),
            F.first("all").alias("all"),
        )

    wrong = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), "file"))
    head = r"(?s)^\s*\[\s*" if field is None else rf'(?s)^\s*\{{.*?"{field}"\s*:\s*\[\s*'
    opening = F.when(F.col("pos") == 0, F.regexp_extract("text", head, 0)).otherwise(F.regexp_extract("text", r"(?s)^\s*,\s*", 0))
    body = F.expr("substring(text, length(opening) + 1)")
    fine = F.col("sound") & (F.col("opening") != "") & body.startswith("{")
    cut = grouped(numbered).withColumn("opening", opening)
    # What follows the last object is none. Filters of the caller must not be tried on it before it is left out.
    text = F.when(fine, F.concat(body, F.lit("}"))).otherwise(wrong("not a JSON array of objects")).alias("text")
    objects = computed_once(computed_once(cut.filter(F.col("pos") < F.col("all"))).select("file", "pos", text))
    ends = grouped(numbered.filter((F.col("pos") == F.col("all")) | (F.col("pos") == 0))).withColumn("opening", opening)
    starts = F.max(F.when((F.col("pos") == 0) & (F.col("all") > 0), F.col("opening")))
    last = F.max(F.when(F.col("pos") == F.col("all"), F.concat("text", F.when(F.col("closed"), "}").otherwise(""))))
    around = ends.groupBy("file").agg(
        F.concat(F.coalesce(starts, F.lit("")), F.coalesce(last, F.lit(""))).alias("text"), F.bool_and("sound").alias("sound")
    )
    if field is None:
        fine = F.col("sound") & F.col("text").rlike(r"^\s*\[\s*\]\s*$")
    else:
        fine = F.col("sound") & F.col("text").rlike(r"^\s*\{")
    return objects, around.select("file", F.when(fine, F.col("text")).otherwise(wrong("not a JSON array")).alias("text"))
