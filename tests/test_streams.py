"""Streams whose memory is a table: replays, late and undated mail, merged runs, pruned scans."""

from __future__ import annotations

import json
import pathlib
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.streaming import jobs
from mailsift.streaming.runs import RunTable


@pytest.fixture
def mail(spark, messages):
    dates = ["2024-03-05 10:00:00", None, "2024-03-04 09:00:00", "2023-12-31 23:59:59", "2024-03-05 00:00:00"]
    data = [{"id": f"m{i % 17}", "thread": f"t{i % 5}", "date": dates[i % 17 % 5], "unread": i % 3 == 0} for i in range(60)]
    return messages(data)


def forget_last_batch(ckpt):
    """As if the job was lost between its writes and the commit of the batch."""
    commits = pathlib.Path(ckpt, "commits")
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    (commits / str(last)).unlink()
    (commits / f".{last}.crc").unlink(missing_ok=True)
    return last


def feed(mail, src, part):
    mail.filter((F.col("ingest_seq") * 7 % 60).between(part * 10, part * 10 + 9)).coalesce(1).write.mode("append").parquet(src)


def test_every_id_once_without_state(spark, mail, tmp_path):
    src, dst, seen, ckpt = (str(tmp_path / x) for x in ("src", "dst", "seen", "ckpt"))
    for part in range(6):
        feed(mail, src, part)
        jobs.dedupe_stream(spark, src, dst, seen, ckpt, fan=2).awaitTermination()
        if part in (1, 3, 4):
            before = rows(spark.read.parquet(dst), "message_id", "ingest_seq")
            assert forget_last_batch(ckpt) == part
            jobs.dedupe_stream(spark, src, dst, seen, ckpt, fan=2).awaitTermination()
            assert rows(spark.read.parquet(dst), "message_id", "ingest_seq") == before
    found = rows(spark.read.parquet(dst), "message_id")
    assert found == sorted((f"m{i}",) for i in range(17))
    assert not pathlib.Path(ckpt, "state").exists()
    kept = RunTable(spark, seen, jobs._SEEN, ["bucket"], 2)
    assert rows(kept.read(6), "message_id") == found
    assert len(RunTable.uncovered(kept.runs())) <= 3


def test_first_in_a_batch_is_by_sequence(spark, messages):
    batch = messages([{"id": "a"}, {"id": "b"}, {"id": "a"}, {"id": None}, {"id": None}])
    none = spark.createDataFrame([], jobs._SEEN)
    got = {(r["message_id"], r["ingest_seq"]) for r in jobs.unseen(batch, none).collect()}
    assert got == {("a", 0), ("b", 1), (None, 3)}
    again = jobs.unseen(batch, jobs.unseen(batch, none).select("message_id", "bucket"))
    assert again.collect() == []


def test_digest_of_the_stream_equals_the_table(spark, mail, tmp_path):
    src, dst, counts, ckpt, labels = (str(tmp_path / x) for x in ("src", "dst", "counts", "ckpt", "labels"))
    known = spark.createDataFrame([("t1", "news", True), ("t2", "bills", False)], "thread_id string, category string, actionable boolean")
    known.write.parquet(labels)
    columns = ["day", "category", "messages", "unread", "threads", "actionable"]
    for part in range(6):
        feed(mail, src, part)
        jobs.digest_stream(spark, src, dst, counts, ckpt, labels, fan=2).awaitTermination()
        if part in (1, 2, 5):
            forget_last_batch(ckpt)
            jobs.digest_stream(spark, src, dst, counts, ckpt, labels, fan=2).awaitTermination()
        here = spark.read.schema(mail.schema).parquet(src)
        assert rows(spark.read.parquet(dst), *columns) == rows(jobs.daily_digest(here, known), *columns)
    undated = spark.read.parquet(dst).filter("day is null")
    assert undated.agg(F.sum("messages")).first()[0] == mail.filter("date_received is null").count() > 0


def test_a_batch_reads_the_folders_of_its_days_and_ids(spark, mail, tmp_path):
    counts = RunTable(spark, str(tmp_path / "counts"), jobs._THREADS, ["date"])
    date = F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit(jobs.UNDATED))
    counts.put(0, jobs.by_day_and_thread(mail).withColumn("date", date))
    fresh = jobs.by_day_and_thread(mail.filter("message_id = 'm3'")).withColumn("date", date)
    plan = jobs.touched_days(counts.read(1), fresh)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*date#\d+[^\]]*2023-12-31", plan)
    seen = RunTable(spark, str(tmp_path / "seen"), jobs._SEEN, ["bucket"])
    seen.put(0, mail.select("message_id", jobs._bucket().alias("bucket")))
    plan = jobs.unseen(mail.filter("message_id = 'm3'"), seen.read(1))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+", plan) and "BroadcastExchange" in plan


@pytest.fixture
def table(spark, tmp_path):
    return RunTable(spark, str(tmp_path / "table"), T.StructType([T.StructField("v", T.LongType()), T.StructField("p", T.IntegerType())]), ["p"], 2)


def test_runs_are_merged_and_read_as_they_were(spark, table):
    sums = lambda rows: rows.groupBy("p").agg(F.sum("v").alias("v")).select("v", "p")
    for batch in range(9):
        for _ in range(2):
            table.vacuum(batch)
            assert (table.read(batch).agg(F.sum("v")).first()[0] or 0) == sum(range(batch))
            table.put(batch, spark.createDataFrame([(batch, batch % 3)], "v long, p int"))
            table.merge(batch, sums)
    assert RunTable.uncovered(table.runs()) == [(0, 7), (8, 8)]
    table.vacuum(9)
    assert table.runs() == [(0, 7), (8, 8)]


def test_a_run_that_was_not_finished_does_not_count(spark, table):
    table.put(0, spark.createDataFrame([(1, 1)], "v long, p int"))
    table.put(1, spark.createDataFrame([(2, 1)], "v long, p int"))
    table._write((0, 1), spark.createDataFrame([(99, 1)], "v long, p int"))
    pathlib.Path(table.path, "run=0_1", "_SUCCESS").unlink()
    assert rows(table.read(2), "v") == [(1,), (2,)]
    table.put(2, spark.createDataFrame([], "v long, p int"))
    assert rows(table.read(3), "v") == [(1,), (2,)] and table.read(0).collect() == []


def raw_line(i, **more):
    headers = [{"name": "From", "value": f"Ann <a{i}@x.org>"}, {"name": "Subject", "value": f"s{i}"}]
    message = {"id": f"m{i}", "threadId": "t", "internalDate": "1704067200000", "labelIds": ["INBOX"], "payload": {"headers": headers}}
    return json.dumps(message | more)


def test_pages_become_messages_and_rejects_once(spark, tmp_path):
    src, dst, bad, ckpt = (str(tmp_path / x) for x in ("src", "dst", "bad", "ckpt"))
    pathlib.Path(src).mkdir()
    pages = [[raw_line(0), raw_line(1, threadId="")], ["{broken", raw_line(2), ""], [raw_line(3), raw_line(0)]]
    for number, page in enumerate(pages):
        pathlib.Path(src, f"page-{number}.jsonl").write_text("\n".join(page) + "\n")
        jobs.pull_stream(spark, src, dst, bad, ckpt).awaitTermination()
        before = rows(spark.read.parquet(dst), "message_id", "ingest_seq"), rows(spark.read.parquet(bad))
        forget_last_batch(ckpt)
        jobs.pull_stream(spark, src, dst, bad, ckpt).awaitTermination()
        assert (rows(spark.read.parquet(dst), "message_id", "ingest_seq"), rows(spark.read.parquet(bad))) == before
    got = spark.read.parquet(dst).orderBy("ingest_seq")
    assert [r["message_id"] for r in got.collect()] == ["m0", "m2", "m3", "m0"]
    assert {r["ingest_seq"] >> jobs.BATCH_BITS for r in got.collect()} == {0, 1, 2}
    assert sorted((r["id"], r["reason"]) for r in spark.read.parquet(bad).select(F.coalesce("id", F.lit("")).alias("id"), "reason").collect()) == [
        ("", "Missing message id"),
        ("m1", "Missing threadId"),
    ]
