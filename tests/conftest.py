from __future__ import annotations

import pathlib
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from mailsift.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        configure(SparkSession.builder.master("local[8]").appName("tests"))
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate one column expression over literals."""

    def run(column):
        return spark.range(1).select(column.alias("v")).collect()[0]["v"]

    return run


@pytest.fixture
def messages(spark):
    """Build a message table from short dicts."""

    def build(rows):
        data = []
        for seq, r in enumerate(rows):
            data.append(
                (
                    r.get("id", f"m{seq}"),
                    r.get("thread", f"t{seq}"),
                    r.get("email", "a@x.org"),
                    r.get("name", ""),
                    r.get("subject", f"s{seq}"),
                    r.get("date", f"2024-01-{seq % 28 + 1:02d} 00:00:00"),
                    r.get("category", "primary"),
                    r.get("labels", ["INBOX"]),
                    r.get("unread", False),
                    seq,
                )
            )
        schema = (
            "message_id string, thread_id string, email string, name string, subject string, date string, "
            "category string, labels array<string>, is_unread boolean, ingest_seq long"
        )
        none = F.array().cast("array<string>")
        return spark.createDataFrame(data, schema).select(
            "message_id",
            "thread_id",
            F.struct("email", "name").alias("sender"),
            F.struct(none.alias("to"), none.alias("cc")).alias("recipients"),
            "subject",
            F.to_timestamp("date").alias("date_received"),
            "category",
            "labels",
            "is_unread",
            F.lit("").alias("snippet"),
            "ingest_seq",
        )

    return build


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
