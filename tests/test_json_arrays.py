"""Arrays of objects that are read in pieces."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from mailsift import checks
from mailsift.sources import json_arrays, readers, writers
from mailsift.sources.json_arrays import elements

from conftest import rows  # noqa: I001


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield use
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def objects(seed, n):
    r = random.Random(seed)
    texts = ["", "}", "{[", '"', "\\", '\\"}', "é{\U0001f600}", "],[", "plain", "\n},\n{", 'a"b}"c{', "\\\\"]
    make = lambda d: {r.choice(texts) + str(i): r.choice([r.choice(texts), 1, None, [r.choice(texts), {}], make(d - 1) if d else {}]) for i in range(r.randint(0, 4))}
    return [make(3) for _ in range(n)]


def read(spark, path, field=None):
    found, around = elements(spark, [str(path)], field)
    got = sorted((r["pos"], json.loads(r["text"])) for r in found.collect())
    assert [p for p, _ in got] == list(range(len(got)))
    return [o for _, o in got], [json.loads(r["text"]) for r in around.collect()]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [150, 1 << 20])
def test_equals_a_json_parser(spark, tmp_path, small_splits, size, indent):
    small_splits(size)
    rows_ = objects(size, 40)
    for ascii_ in (True, False):
        (tmp_path / "a.json").write_text(json.dumps(rows_, indent=indent, ensure_ascii=ascii_), encoding="utf-8")
        assert read(spark, tmp_path / "a.json") == (rows_, [[]])
        whole = {"version": 3, "meta": {"a": {}, "t": '"rows":[{'}, "rows": rows_, "after": [1, "]}"], "end": {}}
        (tmp_path / "b.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=ascii_) + "\n", encoding="utf-8")
        assert read(spark, tmp_path / "b.json", "rows") == (rows_, [whole | {"rows": []}])


def test_a_large_file_is_many_tasks(spark, tmp_path, small_splits):
    small_splits(4096)
    rows_ = [{"n": i, "text": "x" * 50} for i in range(2000)]
    (tmp_path / "a.json").write_text(json.dumps(rows_))
    found, _ = elements(spark, [str(tmp_path / "a.json")])
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 30
    assert sorted(r[0] for r in found.select(F.get_json_object("text", "$.n").cast("int")).collect()) == list(range(2000))


def test_files_without_elements(spark, tmp_path):
    for text in ("[]", " [ ] \n"):
        (tmp_path / "a.json").write_text(text)
        assert read(spark, tmp_path / "a.json") == ([], [[]])
    (tmp_path / "b.json").write_text('{"version": 1, "rows": []}')
    assert read(spark, tmp_path / "b.json", "rows") == ([], [{"version": 1, "rows": []}])
    (tmp_path / "b.json").write_text('{"version": {"a": {"b": 1}}}')
    assert read(spark, tmp_path / "b.json", "rows") == ([], [{"version": {"a": {"b": 1}}}])


BROKEN = ['[{"a": 1}', '[{"a": 1}][{"a": 2}]', '[{"a": 1}][]', '[1, {"a": 1}]', '[{"a": 1}, 2]', '{"a": 1}', "[{]", '[{"a": "x]', " ", "x", '[{"a": 1} {"b": 2}]', "[[{}]]"]


@pytest.mark.parametrize("text", BROKEN)
def test_anything_else_is_an_error(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="not a JSON array"):
        read(spark, tmp_path / "a.json")


@pytest.mark.parametrize("text", ['{"rows": [{"a": 1}]', '{"rows": [{"a": 1}], "more": [{"b": 2}]}', '{"other": [{"a": 1}], "rows": [{}]}', '[{"rows": [{}]}]'])
def test_other_envelopes_are_an_error(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="not a JSON array"):
        read(spark, tmp_path / "a.json", "rows")


RECORD = {"messageId": "m", "threadId": "t", "sender": {"email": "a@x.org"}, "dateReceived": "2024-01-01T00:00:00Z", "isUnread": True}


def test_shards_of_any_number_are_read_back_in_name_order(spark, messages, tmp_path):
    mail = messages([{"id": f"m{i}"} for i in range(6)])
    numbers = [9_998, 9_999, 10_000, 99_998, 99_999, 100_000]
    shards = mail.withColumn("shard", F.element_at(F.array(*map(F.lit, numbers)), (F.col("ingest_seq") + 1).cast("int")).cast("long"))
    path = str(tmp_path / "shards")
    writers.write_numbered(shards, path)
    back = readers.read_messages(spark, path)
    assert [r["message_id"] for r in back.orderBy("ingest_seq").collect()] == ["m0", "m1", "m4", "m5", "m2", "m3"]


def test_a_file_of_two_arrays_fails(spark, tmp_path):
    one = json.dumps([RECORD])
    for text in (one + one, one + "[]"):
        (tmp_path / "batch-00001.json").write_text(text)
        (tmp_path / "batch-00002.json").write_text(one)
        with pytest.raises(Exception, match="not a JSON array"):
            readers.read_messages(spark, str(tmp_path)).collect()


def test_no_plan_gathers_all_files_in_one_task(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"batch-0000{i}.json").write_text(json.dumps([RECORD | {"messageId": f"m{i}"}]))
        (tmp_path / f"lines-{i}.jsonl").write_text('{"id": "a"}\n\n{"id": "b"}\n')
    for df in (readers.read_messages(spark, str(tmp_path)), readers.read_raw_gmail(spark, str(tmp_path / "lines-*.jsonl"))):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString().replace("EnsureRequirements", "")
        assert df.count() in (5, 10)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_split_files_equal_a_json_parser(spark, tmp_path, small_splits, monkeypatch, size):
    """The way of large files, taken for all of them."""
    monkeypatch.setattr(json_arrays, "SMALL", 0)
    small_splits(size)
    rows_ = objects(size, 40)
    (tmp_path / "a.json").write_text(json.dumps(rows_))
    assert read(spark, tmp_path / "a.json") == (rows_, [[]])
    (tmp_path / "b.json").write_text(json.dumps({"version": 3, "rows": rows_}))
    assert read(spark, tmp_path / "b.json", "rows") == (rows_, [{"version": 3, "rows": []}])


@pytest.mark.parametrize("text", BROKEN[:6])
def test_a_large_file_of_anything_else_is_an_error(spark, tmp_path, monkeypatch, text):
    monkeypatch.setattr(json_arrays, "SMALL", 0)
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="not a JSON array"):
        read(spark, tmp_path / "a.json")


def test_small_and_large_files_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_arrays, "SMALL", 1000)
    for number, n in ((1, 3), (2, 40), (3, 2)):
        (tmp_path / f"batch-{number:05d}.json").write_text(json.dumps([RECORD | {"messageId": f"m{number}-{i}"} for i in range(n)]))
    got = [r["message_id"] for r in readers.read_messages(spark, str(tmp_path)).orderBy("ingest_seq").collect()]
    assert got == [f"m{k}-{i}" for k, n in ((1, 3), (2, 40), (3, 2)) for i in range(n)]
    (tmp_path / "batch-00002.json").write_text(json.dumps([RECORD] * 40)[:-1])
    with pytest.raises(Exception, match="not a JSON array"):
        readers.read_messages(spark, str(tmp_path)).collect()


def test_small_files_are_read_in_one_pass(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([RECORD]))
    found, _ = elements(spark, [str(tmp_path / "a.json")])
    assert "Window" not in plan_of(found) and "Join" not in plan_of(found) and "Aggregate" not in plan_of(found)


def test_broken_shards_of_a_failed_run_are_not_read(spark, tmp_path):
    for run, status, text in (("a", "complete", json.dumps([RECORD])), ("b", "failed", "[{")):
        folder = tmp_path / "backfills" / run
        folder.mkdir(parents=True)
        (folder / "batch-00001.json").write_text(text)
        (folder / "backfill-checkpoint.json").write_text(json.dumps({"runId": run, "status": status}))
    assert readers.load_all(spark, str(tmp_path)).count() == 1


@pytest.mark.parametrize("name", ["a1_read_messages", "a9_read_decisions"])
def test_read_order_is_no_single_window(spark, name):
    assert "Window" not in plan_of(checks.QUERIES[name](spark, "/root/testdata/sf0.001"))
