"""Physical plans: what is read, pushed down, shuffled and kept out of Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from mailsift.operators import noise, senders
from mailsift.operators import threads as th
from mailsift.operators.scoring import score_confidence
from mailsift.sources import writers


@pytest.fixture
def table(spark, messages, tmp_path):
    path = str(tmp_path / "mail")
    data = [{"email": f"u{i % 5}@x.org", "date": f"2024-{i % 6 + 1:02d}-05 00:00:00", "labels": ["INBOX"] if i % 2 else []} for i in range(60)]
    writers.write_messages(messages(data), path)
    return spark.read.parquet(path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_months_and_flags_prune_the_scan(table):
    fresh = noise.new_since(table, F.lit("2024-05-01 00:00:00").cast("timestamp"))
    assert re.search(r"PartitionFilters: \[[^\]]*month#\d+ >= 2024-05", plan(fresh))
    chosen = table.select(F.col("sender.email").alias("sender_key"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(in_inbox,true\)|PushedFilters: \[[^\]]*in_inbox", plan(noise.inbox_from(table, chosen)))
    assert fresh.count() == 20 and noise.inbox_from(table, chosen).count() == 30


def test_sender_statistics_read_only_their_columns(table):
    text = plan(score_confidence(senders.sender_stats(table), "2024-06-01 00:00:00"))
    assert "snippet" not in text and "recipients" not in text
    assert "struct<email:string,name:string>" in text or "struct<email:string>" in text
    assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text


def test_profiles_use_hash_aggregation(table):
    text = plan(senders._profiles(table))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_top_subjects_are_cut_before_the_shuffle(table):
    text = plan(senders.sample_subjects(table))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_heads_take_one_shuffle(table):
    text = plan(th.thread_heads(table)).split("Initial Plan")[0]
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
