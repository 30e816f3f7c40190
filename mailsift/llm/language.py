"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in every task, Spark adds the counts up, and the
driver turns them into a matrix of log probabilities of ``FEATURES`` rows and one
column per language. That size does not depend on the number of documents, so the
matrix is broadcast; documents are then scored in batches of sparse rows with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.llm.common import fold

# Hash buckets of n-grams, and the n-gram orders that are counted.
FEATURES = 1 << 15
ORDERS = (1, 2, 3)
# Additive smoothing of the n-gram counts.
SMOOTHING = 0.5
# Code points scored at once.
BATCH_CHARS = 1 << 20
UNDETERMINED = "und"

_PRIOR = -1


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities of hashed n-grams by language, with log priors."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams, the text each belongs to, and whether each text has a letter.

    Texts are lower-cased, anything but letters counts as a blank, and n-grams that hold
    two blanks in a row, or cross a text border, are left out.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\0".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    text_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    letter = _letters()[points]
    has_letter = np.bincount(text_of, letter, len(texts)) > 0
    codes = np.where(letter, points, 32).astype(np.uint64)
    buckets, owners = [], []
    for order in ORDERS:
        size = len(codes) - order + 1
        if size <= 0:
            continue
        value = np.full(size, order, np.uint64)
        good = letter[:size].copy() if order == 1 else np.ones(size, bool)
        for i in range(order):
            value = (value ^ codes[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
            if i:
                good &= letter[i : i + size] | letter[i - 1 : i - 1 + size]
                good &= text_of[i : i + size] == text_of[:size]
        buckets.append((value[good] % np.uint64(FEATURES)).astype(np.int64))
        owners.append(text_of[:size][good])
    return np.concatenate(buckets), np.concatenate(owners), has_letter


def _pieces(texts: list[str]) -> Iterator[list[int]]:
    """Consecutive positions of texts with about ``BATCH_CHARS`` code points in all."""
    held, chars = [], 0
    for i, text in enumerate(texts):
        held.append(i)
        chars += len(text)
        if chars >= BATCH_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    documents: dict[str, int] = {}
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for piece in _pieces(texts):
            names = sorted({langs[i] for i in piece})
            index = {name: k for k, name in enumerate(names)}
            language = np.array([index[langs[i]] for i in piece])
            buckets, owners, _ = features([texts[i] for i in piece])
            table = np.bincount(language[owners] * FEATURES + buckets, minlength=FEATURES * len(names))
            for name, row in zip(names, table.reshape(len(names), FEATURES)):
                counts[name] = counts.get(name, 0) + row
            for i in piece:
                documents[langs[i]] = documents.get(langs[i], 0) + 1
    for name, row in counts.items():
        seen = np.flatnonzero(row)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": [name] * (len(seen) + 1),
                "bucket": np.append(seen, _PRIOR).astype(np.int32),
                "n": np.append(row[seen], documents[name]).astype(np.int64),
            },
            schema=pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())]),
        )


def train(labelled: DataFrame) -> LanguageModel:
    """Fit the model on all rows with text and lang; other rows are passed over.

    What reaches the driver is at most one count per bucket and language. Without a
    labelled row the model knows no language.
    """
    rows = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).dropna()
    counts = (
        rows.mapInArrow(_count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = counts.column("lang").to_numpy(zero_copy_only=False)
    languages = tuple(sorted(set(names)))
    place = np.searchsorted(np.array(languages, dtype=object), names) if languages else np.array([], int)
    buckets, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
    table = np.full((FEATURES, len(languages)), SMOOTHING)
    grams = buckets != _PRIOR
    table[buckets[grams], place[grams]] += n[grams]
    prior = np.zeros(len(languages))
    prior[place[~grams]] = n[~grams]
    log_prior = np.log(prior / max(prior.sum(), 1.0)) if languages else prior
    return LanguageModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32), log_prior)


def classify(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """The most probable language of each text and its posterior probability."""
    found, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return found, scores
    whole = [t or "" for t in texts]
    for piece in _pieces(whole):
        buckets, owners, has_letter = features([whole[i] for i in piece])
        total = np.tile(model.log_prior, (len(piece), 1))
        for k in range(len(model.languages)):
            total[:, k] += np.bincount(owners, model.log_prob[buckets, k], len(piece))
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        best = total.argmax(axis=1)
        share = 1.0 / odds.sum(axis=1)
        for row, i in enumerate(piece):
            if has_letter[row]:
                found[i], scores[i] = model.languages[best[row]], share[row]
    return found, scores


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced.

    Only the column text is looked at. A null, empty or letterless text is ``und`` with
    score 0, as is every text when the model knows no language. Ties go to the language
    that sorts first; repeated rows get equal answers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    at = kept.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = classify(batch.column(at).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    schema = T.StructType([*kept.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(score, schema)


def train_and_identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Fit on the documents outside fold ``held`` and identify all; adds ``held_out`` too.

    A document without an id lies in no fold: it is not learned from and not held out.
    """
    rows = docs.withColumn("held_out", fold("doc_id", folds) == held)
    model = train(rows.filter(~F.col("held_out")))
    return identify(rows.withColumn("held_out", F.coalesce("held_out", F.lit(False))), model)
