"""Toxicity by a weighted finite-state grammar of clauses.

Words become symbols: insults (a lexicon learned from labelled documents, with weights), threat
verbs, targets, negations, reporting verbs, anything else, and clause borders. Five small
transducers rewrite them one after the other; composed, they are one machine that reads a clause
once. What it tells about a clause is a pattern: a plain insult, one aimed at somebody, a denied
or a reported one, or a threat. A document's evidence is, per pattern, the weight of the different
insults found in it; a logistic model weighs the patterns.

1. Labelled documents outside of the held-out fold are sampled: at most ``SAMPLE`` of each label, by
   hash of their id. Word counts per label come from grouping these; what goes to the tasks are at
   most ``LEXICON`` words of at most ``LONGEST`` letters.
2. The model of the patterns is fitted on one fold of the sample with a lexicon of the others, so
   that it sees insults as a new text shows them. The lexicon used is then that of the whole sample.
3. Every text is scored where it lies; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import fold, staged

# Labelled documents of each label that the models are fitted on.
SAMPLE = 1 << 14
# Bounds of the lexicon, and what a word must show to be in it.
LEXICON, LONGEST = 1 << 16, 64
LEAST_DOCUMENTS, LEAST_WEIGHT = 3, 1.5
# Documents' worth of the common rate that a word's counts are smoothed with.
SMOOTH = 4.0
FOLDS, HELD_OUT, FITTED = 5, 0, 1

# Words of the closed classes in English, German, French and Spanish.
NEGATIONS = "not no never nor neither cannot nicht kein keine nie niemals ne pas jamais aucun nunca ni tampoco".split()
REPORTS = (
    "said says say told tells reported reports wrote writes quoted quotes called claims claimed "
    "sagte sagt schrieb schreibt berichtet berichtete dit disait écrit raconte rapporte dijo dice escribió cuenta informó"
).split()
TARGETS = (
    "you your yours yourself he she him her they them u ya "
    "du dich dir dein deine ihr euch euer sie er ihn tu toi te ton ta vous votre vos il elle tú usted ti vosotros ustedes él ella"
).split()
THREATS = (
    "kill hurt beat destroy punch stab shoot crush töten schlagen vernichten erschießen tuer frapper détruire matar golpear destruir"
).split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BORDER = "w", "i", "t", "p", "n", "r", "."
SYMBOLS = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BORDER)
# Words that a negation reaches over, and words between a threat and whom it is for.
REACH = 3
PATTERNS = ("plain", "aimed", "denied", "told", "threat")

_CLASS = {w: s for s, ws in ((THREAT, THREATS), (TARGET, TARGETS), (REPORT, REPORTS), (NEGATION, NEGATIONS)) for w in ws}
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\r\n]+")


@dataclass(frozen=True)
class Transducer:
    """Deterministic arcs (state, symbol) -> (state, symbol written); symbols without an arc are copied."""

    arcs: dict[tuple[int, str], tuple[int, str]]

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (state, symbol))


def negation() -> Transducer:
    """Insults and threats at most REACH words after a negation are denied."""
    arcs = {}
    for left in range(REACH + 1):
        after = max(left - 1, 0)
        arcs |= {(left, NEGATION): (REACH, NEGATION), (left, BORDER): (0, BORDER)}
        arcs |= {(left, s): (after, s) for s in (OTHER, TARGET, REPORT)}
        arcs |= {(left, s): (after, s + "-" if left else s) for s in (INSULT, THREAT)}
    return Transducer(arcs)


def reported() -> Transducer:
    """Insults and threats after a reporting verb are told, up to the clause's end."""
    arcs = {(0, REPORT): (1, REPORT), (1, BORDER): (0, BORDER)}
    return Transducer(arcs | {(1, s): (1, s + '"') for s in (INSULT, THREAT)})


def threats() -> Transducer:
    """A threat verb with a target soon after it is a threat."""
    arcs = {}
    for left in range(REACH + 1):
        after = max(left - 1, 0)
        arcs |= {(left, s): (after, s) for s in (OTHER, INSULT, INSULT + "-", INSULT + '"', NEGATION, REPORT)}
        arcs |= {(left, THREAT): (REACH, OTHER), (left, BORDER): (0, BORDER)}
        arcs[(left, TARGET)] = (0, "threat" if left else TARGET)
    return Transducer(arcs)


def targets() -> Transducer:
    """Insults in a clause that names a target, before or after, are aimed."""
    arcs = {(0, INSULT): (2, INSULT), (1, INSULT): (1, "aimed"), (2, TARGET): (1, "aimed"), (2, "threat"): (1, "threat")}
    arcs |= {(0, s): (1, s) for s in (TARGET, "threat")}
    return Transducer(arcs | {(s, BORDER): (0, BORDER) for s in (1, 2)})


def insults() -> Transducer:
    """Names the pattern of each symbol that carries evidence."""
    names = {INSULT: "plain", INSULT + "-": "denied", INSULT + '"': "told"}
    return Transducer({(0, s): (0, name) for s, name in names.items()})


def composed(machines: list[Transducer]) -> tuple[list[dict[str, int]], list[dict[str, int]]]:
    """One machine for a chain: per state, the next state and the pattern written (or -1) by symbol."""
    start = (0,) * len(machines)
    names, following, written = {start: 0}, [], []
    for state in names_in_order(names):
        follow, write = {}, {}
        for symbol in SYMBOLS:
            out, after = symbol, []
            for machine, at in zip(machines, state):
                at, out = machine.step(at, out)
                after.append(at)
            follow[symbol] = names.setdefault(tuple(after), len(names))
            write[symbol] = PATTERNS.index(out) if out in PATTERNS else -1
        following.append(follow)
        written.append(write)
    return following, written


def names_in_order(names: dict) -> Iterator[tuple]:
    """Keys of a dict that grows while it is gone through."""
    done = 0
    while done < len(names):
        for key in list(names)[done:]:
            done += 1
            yield key


GRAMMAR = composed([negation(), reported(), threats(), targets(), insults()])


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def clause_patterns(clause: list[str], lexicon: dict[str, float]) -> set[tuple[int, str]]:
    """(pattern, word) of the evidence in one clause; an insult aimed afterwards is aimed only."""
    following, written = GRAMMAR
    state, found, last = 0, set(), ""
    for word in clause:
        insult = word in lexicon
        symbol = INSULT if insult else _CLASS.get(word, OTHER)
        pattern = written[state][symbol]
        state = following[state][symbol]
        if pattern >= 0:
            late = pattern == 1 and not insult
            if late:
                found.discard((0, last))
            found.add((pattern, last if late else word))
        if insult:
            last = word
    return found


def evidence(text: str | None, lexicon: dict[str, float]) -> tuple[np.ndarray, int]:
    """Per pattern the weight of the different words found in it, log(1 + words), and clauses matched."""
    text = (text or "").lower()
    split = _WORD.findall(text)
    out, clauses = np.zeros(len(PATTERNS) + 1), 0
    out[-1] = np.log1p(len(split))
    present = set(split)
    if not (lexicon.keys() & present or present & _THREATS):
        return out, 0
    found = set()
    for clause in _CLAUSE.split(text):
        here = _WORD.findall(clause)
        matched = clause_patterns(here, lexicon)
        clauses += bool(matched)
        found |= matched
    for pattern, word in found:
        out[pattern] += lexicon.get(word, 1.0)
    return out, clauses


_THREATS = frozenset(THREATS)
# Where nothing speaks against it, evidence counts in full unless denied or told.
PRIOR = np.array([-4.0, 1.0, 1.2, 0.3, 0.3, 1.0, -0.2])
STRENGTH = np.array([0.01, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5])


def fitted(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic weights (the constant first), held near PRIOR, by Newton steps."""
    x = np.column_stack([np.ones(len(labels)), features]) if len(labels) else np.zeros((0, len(PRIOR)))
    w = PRIOR.copy()
    loss = lambda v: np.logaddexp(0, np.where(labels == 1, -1, 1) * (x @ v)).sum() + (STRENGTH * (v - PRIOR) ** 2).sum() / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - p) - STRENGTH * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(STRENGTH), slope)
        while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sample(labels: DataFrame) -> tuple[DataFrame, dict[int, int], dict[int, int]]:
    """(doc_id, toxic) of the sampled labels, and how many of each label there are in all and in it."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter((fold("doc_id", FOLDS) != HELD_OUT) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    rows = staged(picked[0].unionByName(picked[1]), "toxicity-sample")
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    return rows, total, {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}


def _counts(texts: DataFrame) -> DataFrame:
    """word and the documents of each label that hold it, in the fold for fitting and in the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter() for _ in range(4)]
            for text, toxic, fit in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fit"))):
                counts[2 * fit + toxic].update({w for w in words(text) if len(w) <= LONGEST})
            every = list(set().union(*counts))
            columns = [pa.array(every, pa.string())] + [pa.array([c[w] for w in every], pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "c0", "c1", "f0", "f1"])

    parts = texts.mapInArrow(run, "word string, c0 long, c1 long, f0 long, f1 long")
    return parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("c0", "c1", "f0", "f1")])


def _lexicon(counts: DataFrame, clean: str, toxic: str, documents: tuple[int, int]) -> dict[str, float]:
    """The LEXICON words of most weight: log of how much more often toxic documents hold them."""
    if min(documents) == 0:
        return {}
    share = documents[1] / sum(documents)
    rate = lambda c, part, n: (F.expr(c) + SMOOTH * part) / F.lit(float(n))
    weight = F.log(rate(toxic, share, documents[1]) / rate(clean, 1 - share, documents[0]))
    strong = counts.withColumns({"held": F.expr(toxic), "weight": weight}).filter(
        (F.col("held") >= LEAST_DOCUMENTS) & (F.col("weight") >= LEAST_WEIGHT)
    )
    closed = sorted(_CLASS)
    rows = strong.filter(~F.col("word").isin(closed)).orderBy(F.desc("weight"), "word").limit(LEXICON).select("word", "weight").toArrow()
    return dict(zip(rows.column("word").to_pylist(), rows.column("weight").to_pylist()))


def trained(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon and the weights of the patterns."""
    rows, total, sampled = _sample(labels)
    fit = (fold("doc_id", FOLDS) == FITTED).cast("int").alias("fit")
    # At most two samples' worth of ids.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = staged(texts.join(F.broadcast(rows), "doc_id").select("text", "toxic", fit), "toxicity-texts")
    counts = staged(_counts(texts), "toxicity-words")
    sizes = {(r["fit"], r["toxic"]): r["count"] for r in texts.groupBy("fit", "toxic").count().collect()}
    others = tuple(sizes.get((0, y), 0) for y in (0, 1))
    both = tuple(sizes.get((0, y), 0) + sizes.get((1, y), 0) for y in (0, 1))
    shared = docs.sparkSession.sparkContext.broadcast(_lexicon(counts, "c0", "c1", others))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [evidence(t, shared.value)[0].tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    seen = texts.filter("fit = 1").select("text", "toxic").mapInArrow(run, "toxic int, x array<double>").toArrow()
    x = np.array(seen.column("x").to_pylist()).reshape(-1, len(PATTERNS) + 1)
    y = seen.column("toxic").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    weights = fitted(x[order], y[order])
    if all(sampled.get(v) for v in (0, 1)):
        weights[0] += np.log(total[1] / total[0]) - np.log(sampled[1] / sampled[0])
    return _lexicon(counts, "c0 + f0", "c1 + f1", both), weights


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of matched clauses of every row of ``docs``.

    Null and empty texts match nothing and get the score of no evidence. Labels of one id are
    reduced to their largest; labels that are null, not 0 or 1, or without a document teach
    nothing. Without labels of both kinds there is no lexicon, and only threats are found. Repeated
    rows are scored one by one; a null doc_id is never held out; empty tables give no rows. Of
    ``docs`` only doc_id and text are read, of ``labels`` doc_id and toxic.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = model.value
        for batch in batches:
            found = [evidence(t, lexicon) for t in batch.column("text").to_pylist()]
            x = np.array([f for f, _ in found]).reshape(-1, len(PATTERNS) + 1)
            scores = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([n for _, n in found], pa.int64())],
                names=["doc_id", "held_out", "score", "clauses"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    scored = rows.select("doc_id", held_out, "text").mapInArrow(run, "doc_id long, held_out boolean, score double, clauses long")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")
