from __future__ import annotations

import pathlib

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def sf_docs(spark):
    """The documents of the smallest folder, and their rows."""
    if not pathlib.Path(SF).exists():
        pytest.skip("test tables are not here")
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, df.collect()


@pytest.fixture
def documents(spark):
    """A documents table from dicts; missing fields are null."""

    def build(rows, extra=()):
        schema = T.StructType([*DOCUMENTS, *[T.StructField(c, T.StringType()) for c in extra]])
        return spark.createDataFrame([Row(**{f.name: r.get(f.name) for f in schema}) for r in rows], schema)

    return build


@pytest.fixture
def odd_documents(documents):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977} ends." for i in range(40_000))
    rows = [
        {"doc_id": 1, "text": None, "lang": "en", "source": None},
        {"doc_id": 2, "text": "", "lang": None, "source": "a"},
        {"doc_id": 3, "text": " \t\n ", "lang": "en", "source": "a"},
        {"doc_id": 4, "text": long, "lang": "en", "source": "b"},
        {"doc_id": 5, "text": "One of two equal texts here.", "lang": "en", "source": "b"},
        {"doc_id": 6, "text": "One of two equal texts here.", "lang": "fr", "source": "c"},
        {"doc_id": 7, "text": "A repeated row, as it is.", "lang": "en", "source": "c"},
        {"doc_id": 7, "text": "A repeated row, as it is.", "lang": "en", "source": "c"},
        {"doc_id": None, "text": "A document without an id. \U0001f600 token = abcdefgh12345", "source": "c"},
        {"doc_id": 1 << 40, "text": "12345 67890 !!", "lang": "xx", "source": "d"},
    ]
    clashing = ("kept", "size", "score", "start", "k", "g", "_spans_row", "spans", "value", "bucket", "offset", "_row")
    return documents([r | {c: "x" for c in clashing} for r in rows], clashing)
