"""Harmonic packing of tokenised documents into sequences of fixed capacity.

Class k holds the pieces whose length lies in (capacity/(k+1), capacity/k]; a bin of
class k is full with exactly k pieces. As documents may be cut, a remainder is cut at
the sizes capacity // k, so bins of long pieces are full to within k tokens, and only
pieces of up to ``UNCUT`` tokens go in as they are. Every worker fills its own bins, so
nothing is shuffled; the few bins that stay open at the end of a worker's rows are
merged first-fit by decreasing length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
# Remainders of up to this many tokens are not cut further.
UNCUT = 64
# The token that ends a document.
END = 0
# Texts above this length are tokenised in pieces, cut where the tokeniser splits anyway.
LONG_TEXT = 1 << 20
PIECE_TEXT = 1 << 18
# Sequence numbers that one worker may use.
WORKER_BITS = 36

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)


class ByteTokenizer:
    """Ids of the byte-level vocabulary.

    ``ranks`` names the same vocabulary in the form that the faster library reads. Ids
    are the same; texts that spell a special token go to the first library.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self._plain = Tokenizer.from_file(vocabulary)
        special = [t.content for t in self._plain.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special))) if special else None

    def encode(self, text: str) -> np.ndarray:
        if self._special and self._special.search(text):
            return np.array(self._plain.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(text) <= LONG_TEXT:
            return np.array(self._fast.encode_ordinary(text), np.uint32)
        return np.concatenate([np.array(self._fast.encode_ordinary(p), np.uint32) for p in cut_text(text)])


def cut_text(text: str) -> Iterator[str]:
    """Pieces of a long text, cut before a single blank between two letters or digits.

    The tokeniser splits there in any case and never joins across, so the ids of the
    pieces in a row are the ids of the text. Text without such a place stays whole.
    """
    border = re.compile(r"(?<=[^\W_])(?= [^\W_])")
    start = 0
    while len(text) - start > PIECE_TEXT:
        found = border.search(text, start + PIECE_TEXT)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str, ranks: str, pattern: str) -> ByteTokenizer:
    return ByteTokenizer(vocabulary, ranks, pattern)


def cut_lengths(total: int, capacity: int = CAPACITY, uncut: int = UNCUT) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    lengths = [capacity] * (total // capacity)
    rest = total % capacity
    while rest > uncut:
        k = capacity // rest
        size = rest if rest == capacity // k else capacity // (k + 1)
        lengths.append(size)
        rest -= size
    if rest:
        lengths.append(rest)
    return lengths


class Bins:
    """The open bins of one worker: at most one per class."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        self.capacity, self.next = capacity, worker << WORKER_BITS
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple, length: int) -> Iterator[tuple]:
        """Take a piece; give out the pieces of the bin that it fills, with their places."""
        k = self.capacity // length
        held = self.open.setdefault(k, [])
        held.append((length, piece))
        if len(held) == k:
            yield from self._close(self.open.pop(k))

    def rest(self) -> Iterator[tuple]:
        """Merge what is left, longest first, each piece into the first bin with room."""
        left = sorted((x for held in self.open.values() for x in held), key=lambda x: -x[0])
        bins: list[tuple[int, list]] = []
        for length, piece in left:
            for i, (room, held) in enumerate(bins):
                if room >= length:
                    held.append((length, piece))
                    bins[i] = (room - length, held)
                    break
            else:
                bins.append((self.capacity - length, [(length, piece)]))
        for _, held in bins:
            yield from self._close(held)

    def _close(self, held: list) -> Iterator[tuple]:
        offset = 0
        for length, piece in held:
            yield (*piece, self.next, offset)
            offset += length
        self.next += 1


def pack(
    docs: DataFrame, vocabulary: str, ranks: str, pattern: str, capacity: int = CAPACITY
) -> DataFrame:
    """Cut and pack all documents; one row per piece with its ids as little-endian uint32.

    A null or empty text is the end token alone. A null doc_id is carried as null,
    repeated rows are packed one by one, and only doc_id and text are read.
    """
    arrow = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids", pa.binary()),
            ("doc_tokens", pa.int64()),
            ("sequence_id", pa.int64()),
            ("offset", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary, ranks, pattern).encode
        bins = Bins(TaskContext.get().partitionId(), capacity)
        out: list[tuple] = []
        held = 0
        for batch in batches:
            ids_of = batch.column("doc_id")
            texts = batch.column("text")
            for i in range(batch.num_rows):
                doc_id = ids_of[i].as_py()
                ids = np.append(encode(texts[i].as_py() or ""), np.uint32(END)).astype("<u4")
                start = 0
                for length in cut_lengths(len(ids), capacity):
                    piece = (doc_id, start, length, ids[start : start + length].tobytes(), len(ids))
                    out.extend(bins.add(piece, length))
                    start += length
                held += len(ids)
                if held >= 1 << 20:
                    yield _batch(out, arrow)
                    out, held = [], 0
        out.extend(bins.rest())
        yield _batch(out, arrow)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
    )
