"""Language-model scores by an n-gram trie in Elias-Fano levels.

All words, pairs and triples of the training texts are counted. The trie is dealt to
shards by the word before the last one of a triple, and a token goes once to the shard
of its context, where its texts are both learned from and scored: a shard holds all
pairs and triples of its contexts. A word that is too frequent for one shard deals its
triples by both words of their context instead; its pairs are counted in Spark as rows,
and so are the triples of the few contexts of two words that are themselves too frequent.
What a shard can't know is the probability of a rare word, or of a pair after such a
frequent word. The most frequent words and pairs are broadcast, as many as a fixed number,
and all others are asked for by key, in buckets. A bucket holds a bounded number of keys;
the tokens that ask are dealt to copies of it, so no group of words or of tokens grows
with the corpus.

A smaller model comes from bounded alphabets (``classes`` and ``inner``): pairs of the
most frequent words, triples of fewer of them, and one class for all other words. It
is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import fold, staged
from mailsift.llm.elias_fano import EliasFano

# Tokens of one shard of the trie on average, and of one context before it is dealt in parts or counted as rows.
SHARD_TOKENS, HOT_TOKENS = 1 << 20, 1 << 20
# Words with broadcast counts at most; the cut is at a count, so ties stay together.
FREQUENT = 1 << 17
# Pairs after hot words with broadcast probabilities at most, cut in the same way.
FREQUENT_PAIRS = 1 << 19
# Rare words that one bucket holds on average.
BUCKET_WORDS = 1 << 19
# Rare tokens that are answered in one group on average; a bucket with more is shared by several groups.
GROUP_TOKENS = 1 << 21
# Absolute discount of seen pairs and triples.
DISCOUNT = 0.75
# Steps of quantised log10 probabilities, a byte each.
STEPS = 256
# Tokens that are counted or scored at once; their texts answer to one number.
CHUNK = 1 << 20

# The end of a text: a hash no word gets on purpose.
END = 0x5E0F7EC7_0DD5EED5 - (1 << 62)
# Bytes that are hashed at once; longer words than LONG_WORD are hashed one by one.
_BLOCK, LONG_WORD = 1 << 18, 64
_BYTES = np.arange(256, dtype=np.uint8)
_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 0x20, _BYTES).astype(np.uint8)
# A fixed random number for each byte; that of a word is their sum, weighted by powers of an odd number.
_OF_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b]), 1) for b in range(256)], np.uint64)
_BASE = 0xD6E8FEB86659FD95


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(_BLOCK + LONG_WORD, base, np.uint64)), dtype=np.uint64)


_POWERS, _INVERSES = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words between some places of lower-case bytes."""
    out = np.empty(len(starts), np.uint64)
    short = ends - starts <= LONG_WORD
    cuts = np.searchsorted(starts, np.arange(0, len(data) + _BLOCK, _BLOCK)).tolist()
    for i, j in zip(cuts, cuts[1:]):
        if i == j:
            continue
        first = starts[i]
        values = _OF_BYTE[data[first : starts[j - 1] + LONG_WORD]]
        values *= _POWERS[: len(values)]
        sums = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
        start = starts[i:j] - first
        end = np.where(short[i:j], ends[i:j] - first, start)
        out[i:j] = (sums[end] - sums[start]) * _INVERSES[start]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out.view(np.int64)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts, given as bytes and their bounds, and the number of tokens in each."""
    base = offsets[0]
    data, offsets = _LOWER[data[base : offsets[-1]]], offsets - base
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_SPACE[data]
    begins = word[1:-1] & ~word[:-2]
    stops = word[1:-1] & ~word[2:]
    # Texts lie side by side; no word goes from one into the next.
    inside = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inside] = word[1:-1][inside]
    stops[inside - 1] = word[1:-1][inside - 1]
    starts = np.flatnonzero(begins)
    words = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(words))
    tokens = np.full(len(starts) + len(offsets) - 1, END, np.int64)
    tokens[np.arange(len(starts)) + text] = _hashes(data, starts, np.flatnonzero(stops) + 1)
    return tokens, np.diff(words) + 1


def word_hashes(text: str | None) -> list[int]:
    """Hashes of the words, ASCII letters in lower case, and of the end."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return _tokens(data, np.array([0, len(data)]))[0].tolist()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Rows numbers, hashes of all tokens, and each token's text, by about CHUNK tokens."""
    rows, tokens, lengths, size = [], [], [], 0

    def taken():
        return rows, np.concatenate(tokens), np.repeat(np.arange(len(rows)), np.concatenate(lengths))

    for batch in batches:
        names = batch.column("row").to_pylist()
        texts = batch.column("text").fill_null("").cast(pa.large_binary())
        _, bounds, data = texts.buffers()
        offsets = np.frombuffer(bounds, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(names):
            # Whole texts of about CHUNK bytes.
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
            some, each = _tokens(data, offsets[i : j + 1])
            rows += names[i:j]
            tokens.append(some)
            lengths.append(each)
            size += len(some)
            i = j
            if size >= CHUNK:
                yield taken()
                rows, tokens, lengths, size = [], [], [], 0
    if rows:
        yield taken()


def _pairs_of(schema: tuple[str, str], keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], names=list(schema))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n, uses): every word of ``texts`` (learn, text) by its hash, ends included.

    ``n`` counts texts that are learned from, ``uses`` all texts.
    """

    def emit(held: list[np.ndarray], learned: bool) -> pa.RecordBatch:
        word, uses = np.unique(np.concatenate(held), return_counts=True)
        n = uses if learned else np.zeros(len(uses), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n), pa.array(uses)], names=["word", "n", "uses"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for learns, tokens, text in _chunks(batches):
            learn = np.array(learns, bool)[text]
            for kept, part in zip(held, (tokens[~learn], tokens[learn])):
                kept.append(part)
            if len(held[0]) == 8:
                yield from (emit(kept, learned) for learned, kept in enumerate(held))
                held = ([], [])
        if held[0]:
            yield from (emit(kept, learned) for learned, kept in enumerate(held))

    marked = texts.select(F.col("learn").cast("long").alias("row"), "text")
    counted = marked.mapInArrow(run, "word long, n long, uses long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))


@dataclass(frozen=True)
class Words:
    """Frequent words, sorted by hash, with counts and classes; totals of all words."""

    word: np.ndarray
    count: np.ndarray
    klass: np.ndarray
    tokens: int
    distinct: int
    classes: int

    @property
    def total(self) -> int:
        return self.tokens + self.distinct + 1

    def place(self, tokens: np.ndarray) -> np.ndarray:
        """Places of tokens among the frequent words; -1 for others."""
        if not len(self.word):
            return np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.word, tokens), len(self.word) - 1)
        return np.where(self.word[at] == tokens, at, -1)

    def class_of(self, place: np.ndarray) -> np.ndarray:
        """Classes: 0 is the end, then words by falling count, and ``classes`` the rest."""
        if not len(self.word):
            return np.full(len(place), self.classes)
        return np.where(place >= 0, self.klass[place], self.classes)

    def class_share(self) -> np.ndarray:
        """Add-one probability of every class; the last is all rest."""
        weight = np.zeros(self.classes + 1, np.int64)
        inside = self.klass < self.classes
        weight[self.klass[inside]] = self.count[inside] + 1
        weight[-1] = self.total - weight.sum()
        return np.maximum(weight / self.total, 1e-300)


def frequent_words(counts: DataFrame, limit: int = FREQUENT, classes: int = FREQUENT) -> Words:
    """The words at or above the smallest count that at most ``limit`` words reach.

    What comes to the driver is a row per distinct count and at most ``limit`` words.
    """
    totals = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toArrow()
    n, words = (by_count.column(c).to_numpy() for c in ("n", "words"))
    fits = int((np.cumsum(words) <= limit).sum())
    least = int(n[fits - 1]) if fits else 1 << 62
    table = counts.filter((F.col("n") >= least) | (F.col("word") == END)).toArrow()
    word, count = table.column("word").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(word)
    word, count = word[order], count[order]
    rank = np.lexsort((word, -count, word != END))
    klass = np.empty(len(word), np.int64)
    klass[rank] = np.arange(len(word))
    if len(word) and word[rank[0]] != END:
        klass += 1
    classes = classes + 1
    return Words(word, count, np.minimum(klass, classes), int(totals[0] or 0), int(totals[1] or 0), classes)


class Trie:
    """Seen successors of each context, with quantised log10 probabilities.

    Level 1 are the classes. The successors of all contexts in a row make one sequence
    that never falls, once each context's number times the alphabet's size is added to
    them: a successor is found relative to its context. Level 2 has pairs and level 3
    triples; contexts of triples are numbered pairs of frequent classes. What was not seen
    falls back on the shorter context, with the weight kept per context.
    """

    def __init__(self, share: np.ndarray, inner: int, pairs: tuple, triples: tuple):
        size = len(share)
        self.size, self.inner, self.share = size, inner, share
        context, after = np.divmod(pairs[0], size)
        self.pairs, self.pair_code, self.pair_steps, self.pair_back = _level(
            pairs, context, size, size, lambda: share[after]
        )
        low = np.arange(inner)
        seen = self.pair_log(np.repeat(np.arange(size), inner), np.tile(low, size)).reshape(size, inner)
        self.outer_log = np.log10(np.maximum(1.0 - (10.0**seen).sum(axis=1), 1e-9))
        context, after = np.divmod(triples[0], inner + 1)
        last = context % inner

        def shorter() -> np.ndarray:
            known = np.minimum(after, inner - 1)
            return 10.0 ** np.where(after < inner, self.pair_log(last, known), self.outer_log[last])

        self.triples, self.triple_code, self.triple_steps, self.triple_back = _level(
            triples, context, inner + 1, inner * inner, shorter
        )

    @property
    def nbytes(self) -> int:
        levels = self.pairs.nbytes + self.triples.nbytes + self.pair_code.nbytes + self.triple_code.nbytes
        return levels + self.pair_back.nbytes + self.triple_back.nbytes + self.share.nbytes

    def pair_log(self, context: np.ndarray, after: np.ndarray) -> np.ndarray:
        """log10 of the probability of each class after a class."""
        found, code = _find(self.pairs, self.pair_code, context * self.size + after)
        return np.where(found, self.pair_steps[code], self.pair_back[context] + np.log10(self.share[after]))

    def score(self, before2: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """log10 of the probability of each class after two classes."""
        shorter = self.pair_log(before, after)
        inside = np.flatnonzero((before2 < self.inner) & (before < self.inner))
        if not len(inside):
            return shorter
        context = before2[inside] * self.inner + before[inside]
        target = np.minimum(after[inside], self.inner)
        outer = self.outer_log[before[inside]]
        base = np.where(target < self.inner, shorter[inside], outer)
        found, code = _find(self.triples, self.triple_code, context * (self.inner + 1) + target)
        value = np.where(found, self.triple_steps[code], self.triple_back[context] + base)
        shorter[inside] = value + np.where(target < self.inner, 0.0, shorter[inside] - outer)
        return shorter


def _level(grams: tuple, context: np.ndarray, width: int, contexts: int, shorter) -> tuple:
    """One level from sorted keys (context * width + successor) and counts."""
    keys, counts = grams
    total = np.bincount(context, counts, contexts)
    kinds = np.bincount(context, minlength=contexts)
    weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
    back = np.log10(weight)
    if len(keys):
        values = np.log10((counts - DISCOUNT) / total[context] + weight[context] * shorter())
        low, high = values.min(), values.max()
    else:
        values, low, high = np.zeros(0), -1.0, 0.0
    step = max(high - low, 1e-9) / (STEPS - 1)
    code = np.rint((values - low) / step).astype(np.uint8)
    return EliasFano.of(keys, contexts * width), code, low + step * np.arange(STEPS), back


def _find(level: EliasFano, codes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in a level, and its code."""
    if not level.size:
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.uint8)
    at, found = level.find(keys)
    return found, codes[np.minimum(at, level.size - 1)]


def contexts(klass: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two classes before each token; before a text stand ends."""
    before = np.append(0, klass[:-1])
    before2 = np.append([0, 0], klass[:-2])[: len(klass)]
    first = np.append(True, text[1:] != text[:-1])
    second = np.append(False, first[:-1])
    return np.where(first | second, 0, before2), np.where(first, 0, before)


def count_grams(texts: DataFrame, shared, inner: int) -> tuple[tuple, tuple]:
    """Sorted keys and counts of pairs and triples of classes in ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = shared.value, []

        def emit() -> pa.RecordBatch:
            return _pairs_of(("gram", "n"), *np.unique(np.concatenate(held), return_counts=True))

        for _, tokens, text in _chunks(batches):
            klass = words.class_of(words.place(tokens))
            before2, before = contexts(klass, text)
            held.append(before * (words.classes + 1) + klass)
            inside = (before2 < inner) & (before < inner)
            target = np.minimum(klass[inside], inner)
            held.append(-1 - ((before2[inside] * inner + before[inside]) * (inner + 1) + target))
            if len(held) == 16:
                yield emit()
                held.clear()
        if held:
            yield emit()

    found = texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    gram, n = found.column("gram").to_numpy(), found.column("n").to_numpy()
    out = []
    for keys, counts in ((gram[gram >= 0], n[gram >= 0]), (-1 - gram[gram < 0], n[gram < 0])):
        order = np.argsort(keys)
        out.append((keys[order], counts[order]))
    return out[0], out[1]


_SCORED = (
    "kind int, doc_id long, held_out boolean, row long, n_tokens long, n_known long, log_count double, "
    "log_class double, n_rest long, bucket int, chunk long, words binary, texts binary"
)


def score(
    docs: DataFrame,
    folds: int = 7,
    held: int = 2,
    classes: int | None = None,
    inner: int | None = None,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and score.

    Null and empty texts are an end alone. A document without an id lies in no fold: it is
    neither held out nor learned from. Rows that repeat are documents of their own.
    Without training texts every word is unknown. Only doc_id and text are read.

    The model has all pairs and triples of all words; with ``classes`` and ``inner``, those of
    these alphabets only.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"),
        (F.coalesce(fold("doc_id", folds), F.lit(held)) != held).alias("learn"),
    )
    if (classes is None) != (inner is None):
        raise ValueError("classes and inner are given together")
    if classes is None:
        return _score_all(rows, group_tokens)
    return _score_classes(rows, classes, inner, group_tokens)


def _score_classes(rows: DataFrame, classes: int, inner: int, group_tokens: int) -> DataFrame:
    """Scores by the smaller model of bounded alphabets."""
    training = rows.filter("learn").select(F.lit(0).cast("long").alias("row"), "text")
    counts = staged(count_words(rows), "ngram-words").filter("n > 0")
    words = frequent_words(counts, classes=classes)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(words)
    trie = Trie(words.class_share(), min(inner, words.classes), *count_grams(training, shared, min(inner, words.classes)))
    shared_trie = spark.sparkContext.broadcast(trie)
    buckets = max(1, (words.distinct - len(words.word)) // BUCKET_WORDS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value, shared_trie.value
        table = {"doc_id": [], "held_out": [], "row": []}

        def taken() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, column in table.items():
                    column += batch.column(name).to_pylist()
                yield batch

        for names, tokens, text in _chunks(taken()):
            size = len(names)
            place = known.place(tokens)
            klass = known.class_of(place)
            log_class = model.score(*contexts(klass, text), klass)
            count = known.count[place] if len(known.count) else np.zeros(len(place))
            count = np.where(place >= 0, count, 0)
            rest = klass == known.classes
            sums = lambda x: np.bincount(text, x, size)
            # In the rest class, a word's own share counts too; those of rare words come later.
            own = np.where(rest & (place >= 0), np.log10(count + 1), 0.0)
            yield _scored(
                size,
                kind=0,
                doc_id=table["doc_id"][:size],
                held_out=table["held_out"][:size],
                row=names,
                n_tokens=sums(None).astype(np.int64),
                n_known=sums(count > 0).astype(np.int64),
                log_count=sums(np.log10(count + 1)),
                log_class=sums(log_class + own),
                n_rest=sums(rest).astype(np.int64),
            )
            for column in table.values():
                del column[:size]
            rare = np.flatnonzero(place < 0)
            bucket = np.mod(tokens[rare], buckets)
            for b in np.unique(bucket):
                at = rare[bucket == b]
                word, member = np.unique(tokens[at], return_inverse=True)
                yield _scored(
                    1,
                    kind=1,
                    n_tokens=len(at),
                    chunk=names[0],
                    bucket=int(b),
                    words=[word.tobytes()],
                    texts=[np.stack([text[at], member]).astype(np.int32).tobytes()],
                )

    numbered = rows.select("doc_id", "text", "held_out").withColumn("row", F.monotonically_increasing_id())
    scored = staged(numbered.mapInArrow(run, _SCORED), "ngram-scored")
    asked = scored.filter("kind = 1").select("bucket", "chunk", "words", "texts")
    # Groups follow the tokens that are asked about, which go on growing where new words become few.
    loads = scored.filter("kind = 1").groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    groups = staged(
        loads.select("bucket", F.ceil(F.col("n") / group_tokens).cast("int").alias("groups")), "ngram-groups"
    )
    asked = asked.join(groups, "bucket").withColumn("part", F.pmod(F.xxhash64("chunk"), "groups"))
    least = min(words.count[words.word != END].tolist(), default=1 << 62)
    rare = counts.filter(F.col("n") < least)
    rare = rare.select(F.pmod("word", F.lit(buckets)).cast("int").alias("bucket"), "word", "n")
    rare = rare.join(groups, "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups").cast("long") - 1)).alias("part"), "word", "n"
    )

    def answer(held_counts: pa.Table, questions: pa.Table) -> pa.Table:
        word, n = held_counts.column("word").to_numpy(), held_counts.column("n").to_numpy()
        order = np.argsort(word)
        word, n = word[order], n[order]
        out = [[], [], [], []]
        for question in questions.select(["chunk", "words", "texts"]).to_pylist():
            wanted = np.frombuffer(question["words"], np.int64)
            text, member = np.frombuffer(question["texts"], np.int32).reshape(2, -1)
            count = np.zeros(len(wanted), np.int64)
            if len(word):
                at = np.minimum(np.searchsorted(word, wanted), len(word) - 1)
                count = np.where(word[at] == wanted, n[at], 0)
            each = count[member]
            touched, where = np.unique(text, return_inverse=True)
            out[0].append(touched.astype(np.int64) + question["chunk"])
            out[1].append(np.bincount(where, np.log10(each + 1)))
            out[2].append(np.bincount(where, each > 0).astype(np.int64))
        if not out[0]:
            out = [[np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)], []]
        arrays = [pa.array(np.concatenate(c)) for c in out[:3]]
        return pa.Table.from_arrays(arrays, names=["row", "rare_log", "rare_known"])

    replies = (
        rare.groupBy("bucket", "part")
        .cogroup(asked.select("bucket", "part", "chunk", "words", "texts").groupBy("bucket", "part"))
        .applyInArrow(answer, "row long, rare_log double, rare_known long")
        .groupBy("row")
        .agg(F.sum("rare_log").alias("rare_log"), F.sum("rare_known").alias("rare_known"))
    )
    total = float(np.log10(words.total))
    rest_log = float(np.log10(words.class_share()[-1]))
    return (
        scored.filter("kind = 0")
        .join(replies, "row", "left")
        .withColumn("rare_log", F.coalesce("rare_log", F.lit(0.0)))
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(words.tokens).cast("long").alias("train_tokens"),
            (F.col("log_count") + F.col("rare_log") - F.col("n_tokens") * total).alias("base_score"),
            (F.col("log_class") + F.col("rare_log") - F.col("n_rest") * (total + rest_log)).alias("score"),
        )
    )


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Keys of sequences: a hash of two hashes, in order."""
    z = x.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + y.astype(np.int64).view(np.uint64)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z ^ (z >> np.uint64(32))).view(np.int64)


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are among some sorted ones."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _befores(tokens: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two words before each token; before a text stand ends."""
    before = np.append(END, tokens[:-1])
    before2 = np.append([END, END], tokens[:-2])[: len(tokens)]
    first = np.append(True, text[1:] != text[:-1])
    second = np.append(False, first[:-1])
    return np.where(first | second, END, before2), np.where(first, END, before)


_GRAMS = ["context", "shorter", "word", "n", "uses"]


def hot_grams(rows: DataFrame, hot: np.ndarray, wide: np.ndarray | None = None) -> DataFrame:
    """(key, context, shorter, word, n, uses): pairs after a hot word, or triples after a context in ``wide``.

    All texts are looked at, so that everything asked for is there; ``n`` counts those learned
    from, ``uses`` all. The key of the pair that a triple ends with is ``shorter``, null for a pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit() -> pa.RecordBatch:
            context, shorter, word, learn = (np.concatenate(x) for x in zip(*held))
            held.clear()
            _, first, where = np.unique(_mix(context, word), return_index=True, return_inverse=True)
            n, uses = np.bincount(where, learn, len(first)), np.bincount(where, minlength=len(first))
            shorter = pa.nulls(len(first), pa.int64()) if wide is None else pa.array(shorter[first])
            arrays = [pa.array(context[first]), shorter, pa.array(word[first])]
            arrays += [pa.array(x.astype(np.int64)) for x in (n, uses)]
            return pa.RecordBatch.from_arrays(arrays, names=_GRAMS)

        for learns, tokens, text in _chunks(batches):
            before2, before = _befores(tokens, text)
            at = np.flatnonzero(_among(before, hot))
            context = before[at]
            if wide is not None:
                context = _mix(before2[at], context)
                inside = _among(context, wide)
                at, context = at[inside], context[inside]
            held.append((context, _mix(before[at], tokens[at]), tokens[at], np.array(learns, bool)[text[at]]))
            if sum(len(x[0]) for x in held) >= CHUNK:
                yield emit()
        if any(len(x[0]) for x in held):
            yield emit()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _mix(*(batch.column(c).to_numpy() for c in ("context", "word")))
            yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], names=["key", *_GRAMS])

    kinds = ", ".join(f"{name} long" for name in _GRAMS)
    marked = rows.select(F.col("learn").cast("long").alias("row"), "text")
    grams = marked.mapInArrow(run, kinds).groupBy("context", "shorter", "word")
    # The key follows from the rest and is left out of the shuffle.
    return grams.agg(F.sum("n").alias("n"), F.sum("uses").alias("uses")).mapInArrow(keyed, f"key long, {kinds}")


def _discounted(grams: DataFrame) -> DataFrame:
    """(key, word, p, uses) of grams with the probability of the shorter ones, ``less``.

    Contexts are broadcast: each has more than HOT_TOKENS uses, so they are few.
    """
    seen = grams.filter("n > 0").groupBy("context")
    seen = seen.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    own = F.greatest(F.col("n") - F.lit(DISCOUNT), F.lit(0.0)) / F.col("total")
    back = F.lit(DISCOUNT) * F.col("kinds") / F.col("total")
    p = F.when(F.col("total").isNull(), F.col("less")).otherwise(own + back * F.col("less"))
    return grams.join(F.broadcast(seen), "context", "left").select("key", "word", p.alias("p"), "uses")


def hot_pairs(pairs: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(key, word, p, uses): the probability of each pair of ``hot_grams``."""
    alone = (F.coalesce("uni", F.lit(0)) + 1) / F.lit(float(total))
    words = counts.select("word", F.col("n").alias("uni"))
    return _discounted(pairs.join(words, "word", "left").withColumn("less", alone))


def hot_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, word, p, uses): the probability of each triple of ``hot_grams``."""
    return _discounted(triples.join(pairs.select(F.col("key").alias("shorter"), F.col("p").alias("less")), "shorter"))


def frequent_pairs(pairs: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys, sorted, and probabilities of the pairs at or above the smallest number of uses that at most ``limit`` reach.

    That number is the third value.
    """
    by_uses = pairs.groupBy("uses").agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("uses")).toArrow()
    uses, number = (by_uses.column(c).to_numpy() for c in ("uses", "pairs"))
    fits = int((np.cumsum(number) <= limit).sum())
    least = int(uses[fits - 1]) if fits else 1 << 62
    table = pairs.filter(F.col("uses") >= least).select("key", "p").toArrow()
    key, p = table.column("key").to_numpy(), table.column("p").to_numpy()
    order = np.argsort(key)
    return key[order], p[order], least


class Shard:
    """All seen successors of some contexts, one Elias-Fano level, with their counts.

    Successors of all contexts in a row never fall once each context's number times the
    alphabet's size is added to them.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, contexts: int, width: int):
        """From sorted keys (context * width + successor), those without counts left out."""
        keys, self.counts = keys[counts > 0], counts[counts > 0]
        self.level = EliasFano.of(keys, contexts * width)
        self.total = np.bincount(keys // width, self.counts, contexts)
        self.kinds = np.bincount(keys // width, minlength=contexts)

    def parts(self, context: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The share of each key's own count, and the weight of the shorter context."""
        if not self.level.size:
            return np.zeros(len(keys)), np.ones(len(keys))
        found, n = _find(self.level, self.counts, keys)
        total = np.maximum(self.total[context], 1)
        own = np.where(found, n - DISCOUNT, 0.0) / total
        return own, np.where(self.total[context] > 0, DISCOUNT * self.kinds[context] / total, 1.0)


# Replies come back by spans of so many rows.
SPAN_BITS = 10
# Words of lower rank travel as two bytes, others as this mark and their hash.
_LONG = 0xFFFF


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns of numbers, the bytes of equal weight together, compressed."""
    planes = b"".join(c.view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns if len(c))
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _loose(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd"), np.uint8)


def _numbers(planes: np.ndarray, start: int, size: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return planes[start : start + size * width].reshape(width, size).T.copy().view(kind).reshape(-1)


def _steps(numbers: np.ndarray) -> np.ndarray:
    """Numbers as the first and the differences, which squeeze better."""
    return np.diff(numbers, prepend=numbers.dtype.type(0))


def _coded(codes: np.ndarray, words: np.ndarray) -> bytes:
    return _squeezed(codes, words[codes == _LONG])


def _decoded(data: bytes, size: int, by_rank: np.ndarray) -> np.ndarray:
    planes = _loose(data)
    codes = _numbers(planes, 0, size, np.uint16)
    words = np.zeros(size, np.int64)
    short = codes != _LONG
    words[short] = by_rank[codes[short]]
    words[~short] = _numbers(planes, 2 * size, int(size - short.sum()), np.int64)
    return words


# Kinds of parts: documents, tokens for a shard, sums of texts, questions for a bucket.
_DOCUMENT, _TOKENS, _SUMS, _ASKED = range(4)
_PART = pa.schema(
    [
        ("kind", pa.int32()), ("shard", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("bucket", pa.int32()),
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_known", pa.int64()), ("log_count", pa.float64()),
        ("one", pa.binary()), ("two", pa.binary()), ("three", pa.binary()), ("texts", pa.binary()),
    ]
)
_PART_SQL = (
    "kind int, shard int, chunk long, n long, bucket int, doc_id long, held_out boolean, n_known long, "
    "log_count double, one binary, two binary, three binary, texts binary"
)


def _parts(size: int, **columns) -> pa.RecordBatch:
    arrays = []
    for field in _PART:
        value = columns.get(field.name)
        if value is None:
            arrays.append(pa.nulls(size, field.type))
        else:
            arrays.append(pa.array([value] * size if isinstance(value, int) else value, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_PART)


def _questions(key: np.ndarray, x: np.ndarray, y: np.ndarray, row: np.ndarray, buckets: int, shard: int) -> pa.RecordBatch:
    """Tokens whose log10(x + y * p) waits for the p of a key; a row for each bucket that is asked."""
    bucket = np.mod(key, buckets)
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(order)]))
    key, x, y, row = key[order], x[order].astype(np.float32), y[order].astype(np.float32), row[order]
    one = [_squeezed(key[i:j], x[i:j], y[i:j], _steps(row[i:j])) for i, j in cuts]
    n = [j - i for i, j in cuts]
    return _parts(len(cuts), kind=_ASKED, shard=shard, chunk=int(row[0]), n=n, bucket=names.tolist(), one=one)


def _replies(row: np.ndarray, sums: np.ndarray, count: np.ndarray | None) -> Iterator[tuple[int, int, bytes]]:
    """(span, n, packed) of numbers that belong to texts, for each span of rows.

    Counts are those of rare words; without them, sums of a text are added up first.
    """
    if count is None:
        row, where = np.unique(row, return_inverse=True)
        sums = np.bincount(where, sums)
        count = np.zeros(0, np.int64)
    else:
        order = np.argsort(row, kind="stable")
        row, sums, count = row[order], sums[order], count[order]
    span = row >> SPAN_BITS
    names, starts = np.unique(span, return_index=True)
    at = (row & ((1 << SPAN_BITS) - 1)).astype(np.uint16)
    sums = sums.astype(np.float32)
    for name, i, j in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(row)]):
        yield name, j - i, _squeezed(_steps(at[i:j]), sums[i:j], count[i:j])


def _score_all(rows: DataFrame, group_tokens: int) -> DataFrame:
    """Scores by all pairs and triples of all words."""
    spark = rows.sparkSession
    used = staged(count_words(rows), "ngram-words")
    counts = used.filter("n > 0")
    words = frequent_words(counts)
    tokens = int(used.agg(F.sum("uses")).first()[0] or 0)
    shards = tokens // SHARD_TOKENS + 1
    hot = np.sort(used.filter(F.col("uses") > HOT_TOKENS).select("word").toArrow().column("word").to_numpy())
    by_rank = words.word[np.lexsort((words.word, -words.count))]
    rank = np.full(len(words.word), _LONG)
    rank[np.lexsort((words.word, -words.count))] = np.minimum(np.arange(len(words.word)), _LONG)

    # What is asked for by key: rare words, with their counts, and what follows hot words.
    total = float(words.total)
    least = min(words.count[words.word != END].tolist(), default=1 << 62)
    values = counts.filter((F.col("n") < least) & (F.col("word") != END))
    values = values.select(F.col("word").alias("key"), "n", ((F.col("n") + 1) / F.lit(total)).alias("p"))
    asked_keys = max(0, words.distinct - len(words.word))
    wide, pair_key, pair_p = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if len(hot):
        pairs = staged(hot_pairs(staged(hot_grams(rows, hot), "ngram-hot"), counts, words.total), "ngram-hot-pairs")
        pair_key, pair_p, often = frequent_pairs(pairs, FREQUENT_PAIRS)
        grams = pairs.filter(F.col("uses") < often)
        # A pair is a context as often as it is used, unless it ends its text; each text begins after two ends.
        wide = pairs.filter((F.col("uses") > HOT_TOKENS) & (F.col("word") != END)).select("key").toArrow()
        wide = wide.column("key").to_numpy()
        if END in hot:
            wide = np.append(wide, _mix(np.array([END]), np.array([END])))
        wide = np.sort(wide)
        if len(wide):
            triples = hot_triples(staged(hot_grams(rows, hot, wide), "ngram-wide"), pairs)
            grams = staged(grams.unionByName(triples), "ngram-hot-values")
        asked_keys += grams.count()
        values = values.unionByName(grams.select("key", F.lit(-1).cast("long").alias("n"), "p"))
    shared = spark.sparkContext.broadcast((words, hot, wide, pair_key, pair_p, by_rank, rank.astype(np.uint16)))
    buckets = asked_keys // BUCKET_WORDS + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hot, wide, _, _, _, rank = shared.value
        table = {"doc_id": [], "held_out": [], "learn": []}

        def taken() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, column in table.items():
                    column += batch.column(name).to_pylist()
                yield batch

        for names, tokens, text in _chunks(taken()):
            size = len(names)
            learn = np.array(table["learn"][:size], bool)
            place = known.place(tokens)
            rare = place < 0
            count = np.where(rare, 0, known.count[place] if len(known.count) else 0)
            here = names[0] % shards
            yield _parts(
                size,
                kind=_DOCUMENT,
                shard=here,
                chunk=names,
                n=np.bincount(text, minlength=size),
                doc_id=table["doc_id"][:size],
                held_out=table["held_out"][:size],
                n_known=np.bincount(text, count > 0, size).astype(np.int64),
                log_count=np.bincount(text, np.log10(count + 1), size),
            )
            for column in table.values():
                del column[:size]
            before2, before = _befores(tokens, text)
            after_hot = _among(before, hot)
            context = before.copy()
            context[after_hot] = _mix(before2[after_hot], before[after_hot])
            by_key = after_hot & _among(context, wide)
            row = text + names[0]
            if by_key.any():
                key = _mix(context[by_key], tokens[by_key])
                yield _questions(key, np.zeros(len(key)), np.ones(len(key)), row[by_key], buckets, here)
            # A shard asks about rare words itself, except after hot words; there the count alone is asked for.
            alone = after_hot & rare
            if alone.any():
                key = tokens[alone]
                yield _questions(key, np.ones(len(key)), np.zeros(len(key)), row[alone], buckets, here)

            code = np.where(rare, np.uint16(_LONG), rank[place] if len(rank) else np.uint16(_LONG)).astype(np.uint16)
            end_code = code[-1]
            first = np.append(True, text[1:] != text[:-1])
            second = first | np.append(False, first[:-1])
            code1 = np.where(first, end_code, np.append(end_code, code[:-1]))
            code2 = np.where(second, end_code, np.append([end_code, end_code], code[:-2])[: len(code)])
            shard = np.mod(context, shards)
            shard[by_key] = shards
            order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
            names_of, starts = np.unique(shard[order], return_index=True)
            cuts = list(zip(names_of.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]))
            cuts = [c for c in cuts if c[0] < shards]
            texts = (text * 2 + learn[text]).astype(np.uint32)[order]
            streams = []
            for c, w in ((code2, before2), (code1, before), (code, tokens)):
                c, w = c[order], w[order]
                streams.append([_coded(c[i:j], w[i:j]) for _, i, j in cuts])
            if cuts:
                yield _parts(
                    len(cuts), kind=_TOKENS, shard=[c[0] for c in cuts], chunk=names[0], n=[j - i for _, i, j in cuts],
                    one=streams[0], two=streams[1], three=streams[2], texts=[_squeezed(_steps(texts[i:j])) for _, i, j in cuts],
                )

    def learn_and_score(key: tuple, table: pa.Table) -> pa.Table:
        known, hot, _, pair_key, pair_p, by_rank, _ = shared.value
        kinds = table.column("kind").to_numpy()
        out = [table.filter(pa.array(kinds != _TOKENS))]
        blocks = table.filter(pa.array(kinds == _TOKENS)).select(["chunk", "n", "one", "two", "three", "texts"]).to_pylist()
        if not blocks:
            return out[0]
        a, b, c = (np.concatenate([_decoded(x[s], x["n"], by_rank) for x in blocks]) for s in ("one", "two", "three"))
        texts = [np.cumsum(_numbers(_loose(x["texts"]), 0, x["n"], np.uint32), dtype=np.uint32) for x in blocks]
        row = np.concatenate([(t >> 1).astype(np.int64) + x["chunk"] for t, x in zip(texts, blocks)])
        learn = np.concatenate([(t & 1).astype(bool) for t in texts])

        # Words and contexts by numbers of this shard; then each different triple once.
        word, c = np.unique(c, return_inverse=True)
        context, ab = np.unique(_mix(a, b), return_inverse=True)
        del a
        code = ab * len(word) + c
        # Like np.unique, which would sort stably for the same.
        at = np.argsort(code)
        first = np.append(True, code[at[1:]] != code[at[:-1]])
        where = np.empty(len(at), np.int64)
        where[at] = np.cumsum(first) - 1
        at = at[first]
        unique = code[at]
        del code, first
        n = np.bincount(where, learn, len(unique)).astype(np.int64)
        triples = Shard(unique, n, len(context), len(word))
        ab, b, c = ab[at], b[at], c[at]
        x, y = triples.parts(ab, unique)
        # Only words that are not hot have all their pairs here.
        ours = ~_among(b, hot)
        some = np.flatnonzero(ours)
        if len(some):
            middle, b_of = np.unique(b[some], return_inverse=True)
            pair, of = np.unique(b_of * len(word) + c[some], return_inverse=True)
            n = np.bincount(of, n[some], len(pair)).astype(np.int64)
            own, back = Shard(pair, n, len(middle), len(word)).parts(pair // len(word), pair)
            x[some] += y[some] * own[of]
            y[some] *= back[of]
        place = known.place(word)[c]
        ready = ours & (place >= 0)
        share = (np.where(ready, known.count[place] if len(known.count) else 0, 0) + 1) / known.total
        keys = np.where(ours, word[c], _mix(b, word[c]))
        after_hot = np.flatnonzero(~ours)
        if len(pair_key) and len(after_hot):
            wanted = keys[after_hot]
            at = np.minimum(np.searchsorted(pair_key, wanted), len(pair_key) - 1)
            ready[after_hot] = pair_key[at] == wanted
            share[after_hot] = pair_p[at]
        sums = np.log10(np.where(ready, x + y * share, 1.0))

        waits = ~ready[where]
        if waits.any():
            u = where[waits]
            asked = _questions(keys[u], x[u], y[u], row[waits], buckets, int(blocks[0]["chunk"] % shards))
            out.append(pa.Table.from_batches([asked]))
        done = ~waits
        if done.any():
            spans, sizes, packed = zip(*_replies(row[done], sums[where[done]], None))
            of_texts = _parts(len(spans), kind=_SUMS, shard=0, chunk=list(spans), n=list(sizes), one=list(packed))
            out.append(pa.Table.from_batches([of_texts]))
        return pa.concat_tables([t.cast(_PART) for t in out])

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.mapInArrow(deal, _PART_SQL)
    found = staged(dealt.groupBy("shard").applyInArrow(learn_and_score, _PART_SQL), "ngram-scored")

    asked = found.filter(F.col("kind") == _ASKED).select("bucket", "chunk", "n", "one")
    # Groups follow the tokens that are asked about, which go on growing where new words become few.
    loads = asked.groupBy("bucket").agg(F.sum("n").alias("n"))
    groups = staged(loads.select("bucket", F.ceil(F.col("n") / group_tokens).cast("int").alias("groups")), "ngram-groups")
    asked = asked.join(groups, "bucket").withColumn("part", F.pmod(F.xxhash64("chunk", "n"), "groups"))
    values = values.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int")).join(groups, "bucket")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups").cast("long") - 1))
    values = values.select("bucket", parts.alias("part"), "key", "n", "p")
    nothing = 1.0 / total

    def answer(held: pa.Table, questions: pa.Table) -> pa.Table:
        key, n, p = (held.column(c).to_numpy() for c in ("key", "n", "p"))
        order = np.argsort(key)
        key, n, p = key[order], n[order], p[order]
        found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        for question in questions.select(["n", "one"]).to_pylist():
            planes, size = _loose(question["one"]), question["n"]
            wanted = _numbers(planes, 0, size, np.int64)
            x, y = (_numbers(planes, at * size, size, np.float32).astype(np.float64) for at in (8, 12))
            value, count = np.full(size, nothing), np.zeros(size, np.int64)
            if len(key):
                at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                match = key[at] == wanted
                value, count = np.where(match, p[at], value), np.where(match, np.maximum(n[at], 0), count)
            found.append((np.cumsum(_numbers(planes, 16 * size, size, np.int64)), np.log10(x + y * value), count))
        packed = list(_replies(*(np.concatenate(c) for c in zip(*found))))
        spans, sizes, data = zip(*packed) if packed else ((), (), ())
        kinds = (pa.int64(), pa.int64(), pa.binary())
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip((spans, sizes, data), kinds)], names=["span", "n", "one"])

    def add(table: pa.Table) -> pa.Table:
        size = 1 << SPAN_BITS
        touched = np.zeros(size, bool)
        score, rare_log, rare_known = np.zeros(size), np.zeros(size), np.zeros(size)
        for reply in table.select(["n", "one"]).to_pylist():
            planes, n = _loose(reply["one"]), reply["n"]
            at = np.cumsum(_numbers(planes, 0, n, np.uint16), dtype=np.uint16)
            touched[at] = True
            score += np.bincount(at, _numbers(planes, 2 * n, n, np.float32), size)
            if len(planes) > 6 * n:
                count = _numbers(planes, 6 * n, n, np.int64)
                rare_log += np.bincount(at, np.log10(count + 1), size)
                rare_known += np.bincount(at, count > 0, size)
        at = np.flatnonzero(touched)
        arrays = [at + (table.column("span")[0].as_py() << SPAN_BITS), score[at], rare_log[at], rare_known[at].astype(np.int64)]
        return pa.Table.from_arrays([pa.array(x) for x in arrays], names=["chunk", "score", "rare_log", "rare_known"])

    sums = found.filter(F.col("kind") == _SUMS).select(F.col("chunk").alias("span"), "n", "one")
    replies = (
        values.groupBy("bucket", "part")
        .cogroup(asked.select("bucket", "part", "n", "one").groupBy("bucket", "part"))
        .applyInArrow(answer, "span long, n long, one binary")
        .unionByName(sums)
        .groupBy("span")
        .applyInArrow(add, "chunk long, score double, rare_log double, rare_known long")
    )
    return (
        found.filter(F.col("kind") == _DOCUMENT)
        .join(replies, "chunk", "left")
        .select(
            "doc_id",
            "held_out",
            F.col("n").alias("n_tokens"),
            (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(words.tokens).cast("long").alias("train_tokens"),
            (F.col("log_count") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n") * float(np.log10(total))).alias("base_score"),
            "score",
        )
    )


def _scored(size: int, **columns) -> pa.RecordBatch:
    types = {
        "kind": pa.int32(), "doc_id": pa.int64(), "held_out": pa.bool_(), "row": pa.int64(), "n_tokens": pa.int64(),
        "n_known": pa.int64(), "log_count": pa.float64(), "log_class": pa.float64(), "n_rest": pa.int64(),
        "bucket": pa.int32(), "chunk": pa.int64(), "words": pa.binary(), "texts": pa.binary(),
    }
    arrays = []
    for name, kind in types.items():
        value = columns.get(name)
        if value is None:
            arrays.append(pa.nulls(size, kind))
        else:
            arrays.append(pa.array([value] * size if isinstance(value, int) else value, kind))
    return pa.RecordBatch.from_arrays(arrays, names=list(types))
