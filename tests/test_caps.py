"""Long names, lines, tags, ids, shard names and deep MIME trees are read whole."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from mailsift.functions import address, text
from mailsift.operators.normalize import extract_bodies
from mailsift.sources import readers


@pytest.mark.parametrize("size", [10, 200, 201, 300, 5000])
def test_long_names_in_headers(value, size):
    name = "N" * size
    got = value(address.from_header(F.lit(f"{name} <a@x.org>")))
    assert (got["email"], got["name"]) == ("a@x.org", name)
    assert value(address.address_list(F.lit(f"b@x.org, {name} <a@x.org>"))) == ["b@x.org", "a@x.org"]


@pytest.mark.parametrize("size", [10, 511, 600, 5000])
def test_long_lines_and_tags(value, size):
    line = "q" * size
    assert value(text.unique_content(F.lit(f"own\n> {line}\nmore\nFrom: {line}\nold"))) == "own\nmore"
    assert value(text.strip_html(F.lit(f"a<b x='{line}'>c"))) == "a c"
    assert value(text.legacy_message_id(F.lit(f"Message {line}: bad"))) == line


def test_deep_mime_trees(spark):
    part = {"mimeType": "text/plain", "body": {"data": "aGk="}}
    for _ in range(14):
        part = {"mimeType": "multipart/mixed", "parts": [part]}
    line = json.dumps({"id": "m1", "payload": part})
    raw = spark.createDataFrame([(line,)], "value string").select(F.from_json("value", readers.RAW_GMAIL).alias("r")).select("r.*")
    assert rows(extract_bodies(raw)) == [("m1", "hi")]


def test_shard_names_of_any_length(spark, tmp_path):
    record = {"threadId": "t", "sender": {"email": "a@x.org"}, "dateReceived": "2024-01-01T00:00:00Z", "isUnread": True}
    for digits, ids in (("00002", ["c"]), ("00001", ["a", "b"]), ("12345678901", ["d"])):
        (tmp_path / f"batch-{digits}.json").write_text(json.dumps([{**record, "messageId": i} for i in ids]))
    got = readers.read_messages(spark, str(tmp_path)).orderBy("ingest_seq").collect()
    assert [r["message_id"] for r in got] == ["a", "b", "c", "d"]
    assert len({r["ingest_seq"] for r in got}) == 4


def test_lines_are_numbered_alike_however_files_are_split(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.json").write_text("".join(json.dumps({"id": f"{name}{i}"}) + "\n" for i in range(500)))
    seen = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        read = readers.read_raw_gmail(spark, str(tmp_path)).orderBy("ingest_seq")
        seen.append([(r["ingest_seq"], r["id"]) for r in read.collect()])
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1]
    assert [i for _, i in seen[0]] == [f"{n}{i}" for n in "ab" for i in range(500)]
