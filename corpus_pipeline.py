"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes the documents that the one before kept and is written down before the
next one reads it. All but the last return documents with their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm import language, mixing, neardup, packing, secrets
from mailsift.llm.common import fold, read_table, staged
from mailsift.llm.queries import tokenizer_files

# Posterior probability below which a document's language counts as unknown.
LEAST_SCORE = 0.5
# Folds of the labelled documents, and the one that the language model does not learn from.
FOLDS, HELD_OUT = 4, 2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language; a missing lang is filled in with the one found.

    The model learns from the labelled documents of this input, but for one fold in four. Where
    it finds none to learn from, it knows no language, and documents with a letter stay as they
    are. Null, empty and letterless texts go. Rows are judged one by one, so repeated rows and
    rows without a doc_id fare alike; an empty table stays empty. Further columns are carried.
    """
    rows = docs.select("doc_id", "text", "lang", F.struct("*").alias("doc"))
    model = language.train(rows.filter(fold("doc_id", FOLDS) != HELD_OUT))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language.identify(rows, model)
    kept = found.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    filled = {"lang": F.coalesce("doc.lang", "lang_pred")}
    return kept.select(*[filled.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates: that of the smallest doc_id, nulls last.

    Rows are numbered once and compared as rows: repeated rows of one doc_id are a group, rows
    without a doc_id are compared like any other, and of rows with equal ids one stays. Null,
    empty and wordless texts are like nothing and stay. An empty table stays empty. Further
    columns are carried.
    """
    names = docs.columns
    numbered = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "pipeline-rows")
    rows = numbered.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))
    groups = neardup.near_duplicates(rows).select(F.col("doc_id").alias("row"), "component_id")
    several = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component_id")
    rank = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), "row")
    members = staged(groups.join(several, "component_id").join(numbered.select("row", rank.alias("rank")), "row"), "pipeline-groups")
    best = members.groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank.row")
    gone = members.select("row").join(best, "row", "left_anti")
    return numbered.join(gone, "row", "left_anti").select(*[F.col(f"doc.`{c}`").alias(c) for c in names])


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace live-looking secrets in the texts; every row stays.

    Null and empty texts stay as they are; repeated rows and rows without a doc_id are treated
    alike, row by row. An empty table stays empty. Further columns are carried.
    """
    return secrets.redact(secrets.scan(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents by the targets of their sources, some more than once.

    Rows without a source are a source of their own, the last. Null, empty and wordless texts
    have no size and are never taken. Repeated rows are rows of their own; no row is taken more
    than three times. An empty table stays empty. Further columns are carried.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the documents into pieces and the pieces into sequences; ids are part of the result.

    A null or empty text is its end mark alone. Repeated rows and rows without a doc_id are
    packed one by one. An empty table gives no pieces. Further columns are dropped.
    """
    return packing.pack(docs, *tokenizer_files())


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Hash orders, tokenisers and learned models have no SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
