"""Raw dialects, files, streams, recovery, data quality, model interfaces."""

from __future__ import annotations

import base64
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from conftest import rows
from mailsift.operators import backfill as bf
from mailsift.operators import folders as fd
from mailsift.operators import infer, normalize, quality
from mailsift.plans import composed
from mailsift.schema import MESSAGE, RAW_GMAIL, RAW_GRAPH
from mailsift.sources import readers, writers
from mailsift.streaming import jobs

# --- raw dialects -----------------------------------------------------------------------


def gmail(spark, *raw):
    df = spark.createDataFrame([(json.dumps(r), i) for i, r in enumerate(raw)], "j string, ingest_seq long")
    return df.select(F.from_json("j", RAW_GMAIL).alias("r"), "ingest_seq").select("r.*", "ingest_seq")


def message(**over):
    base = {
        "id": "m1",
        "threadId": "t1",
        "labelIds": ["INBOX", "UNREAD", "CATEGORY_PROMOTIONS"],
        "snippet": "Hey",
        "internalDate": "1704164645678",
        "payload": {"mimeType": "text/plain", "headers": [{"name": "FROM", "value": "Ann <a@x.org>"}, {"name": "to", "value": "b@x.org"}]},
    }
    return base | over


def test_gmail_message(spark):
    messages, rejects = normalize.normalize_gmail(gmail(spark, message()))
    got = messages.first()
    assert rejects.count() == 0
    assert (got["sender"]["email"], got["sender"]["name"], got["recipients"]["to"], got["recipients"]["cc"]) == ("a@x.org", "Ann", ["b@x.org"], [])
    assert (got["subject"], got["category"], got["is_unread"]) == ("(no subject)", "promotions", True)
    assert messages.select(F.date_format("date_received", "yyyy-MM-dd HH:mm:ss.SSS").alias("d")).first()["d"] == "2024-01-02 03:04:05.678"


def headers(*pairs):
    return {"payload": {"headers": [{"name": n, "value": v} for n, v in pairs]}}


@pytest.mark.parametrize(
    ("over", "reason"),
    [
        ({"id": None, "threadId": None}, "Missing message id"),
        ({"threadId": ""}, "Missing threadId"),
        ({"internalDate": None, "payload": None}, "Missing internalDate"),
        ({"payload": None}, "Missing payload"),
        (headers(("Subject", "x"), ("From", None)), "Missing From header"),
        (headers(("From", "not-an-email")), "Schema validation failed"),
        (headers(("From", "a@x.org"), ("Cc", "b@x.org, oops")), "Schema validation failed"),
        ({"internalDate": "soon"}, "Schema validation failed"),
    ],
)
def test_gmail_rejects(spark, over, reason):
    messages, rejects = normalize.normalize_gmail(gmail(spark, message(**over)))
    assert messages.count() == 0
    assert [r["reason"] for r in rejects.collect()] == [reason]


def test_empty_subject_stays_empty_in_gmail_only(spark):
    messages, _ = normalize.normalize_gmail(gmail(spark, message(**headers(("From", "a@x.org"), ("Subject", "")))))
    assert messages.first()["subject"] == ""


def graph(spark, *raw):
    df = spark.createDataFrame([(json.dumps(r), i) for i, r in enumerate(raw)], "j string, ingest_seq long")
    return df.select(F.from_json("j", RAW_GRAPH).alias("r"), "ingest_seq").select("r.*", "ingest_seq")


def test_graph_messages(spark):
    full = {
        "id": "g1",
        "conversationId": "",
        "from": {"emailAddress": {"address": "Ann@X.org", "name": "Ann"}},
        "toRecipients": [{"emailAddress": {"address": "B@x.org"}}, {"emailAddress": {}}, {}],
        "subject": "",
        "receivedDateTime": "2024-01-02T03:04:05Z",
        "categories": ["Red", ""],
        "parentFolderId": "in",
        "flag": {"flagStatus": "flagged"},
        "importance": "high",
    }
    bad = [full | {"id": ""}, full | {"from": None}, full | {"from": {"emailAddress": {"name": "x"}}}, full | {"receivedDateTime": ""}]
    messages, rejects = normalize.normalize_graph(graph(spark, full, full | {"id": "g2", "isRead": False}, *bad), "in")
    one, two = messages.orderBy("ingest_seq").collect()
    assert (one["thread_id"], one["subject"], one["sender"]["email"], one["recipients"]["to"]) == ("g1", "(no subject)", "ann@x.org", ["b@x.org"])
    # A missing read flag counts as unread, but only a false one gives the label.
    assert one["is_unread"] and one["labels"] == ["INBOX", "STARRED", "IMPORTANT", "Red"]
    assert two["labels"][:2] == ["INBOX", "UNREAD"]
    assert sorted(r["reason"] for r in rejects.collect()) == ["Missing from", "Missing from address", "Missing id", "Schema validation failed"]


def test_both_dialects_give_one_schema(spark):
    a = normalize.normalize_gmail(gmail(spark, message()))[0]
    b = normalize.normalize_graph(graph(spark, {"id": "x"}), "in")[0]
    kinds = lambda df: [(f.name, f.dataType.simpleString()) for f in df.schema]
    assert kinds(a) == kinds(b) == [(f.name, f.dataType.simpleString()) for f in MESSAGE]


def b64(text):
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def part(mime, text=None, parts=None):
    out = {"mimeType": mime}
    if text is not None:
        out["body"] = {"data": b64(text)}
    if parts is not None:
        out["parts"] = parts
    return out


def nested(depth):
    leaf = part("text/plain", "deep")
    for _ in range(depth):
        leaf = part("multipart/mixed", parts=[leaf])
    return leaf


@pytest.mark.parametrize(
    ("payload", "body"),
    [
        (part("text/plain", "hello ÿ"), "hello ÿ"),
        (part("multipart/alternative", parts=[part("text/html", "<b>x</b>"), part("text/plain", "plain")]), "plain"),
        (part("multipart/mixed", parts=[part("multipart/alternative", parts=[part("text/html", "<p>one</p>")]), part("text/html", "two")]), "one"),
        (part("multipart/mixed", parts=[part("text/html", "<p>x</p>"), part("text/plain")]), ""),
        (part("multipart/mixed", parts=[part("application/pdf", "x"), part("text/html", "<p>y</p>")]), "y"),
        (part("application/pdf", "x"), ""),
        (nested(10), "deep"),
        (nested(11), "deep"),
        (nested(39), "deep"),
        (None, ""),
    ],
)
def test_bodies(spark, payload, body):
    assert normalize.extract_bodies(gmail(spark, message(payload=payload))).first()["body"] == body


# --- folders ----------------------------------------------------------------------------


def test_folders(spark):
    data = [("f1", "Inbox", None, 120), ("f2", "Deleted Items", None, 40), ("f3", "Old", "f2", 7), ("f4", "Older", "f3", 3), ("f5", "Projects", None, 60), ("f6", "Junk Email", None, 9)]
    folders = spark.createDataFrame(data, "id string, display_name string, parent_id string, total_items long")
    closed = fd.folder_closure(folders, fd.excluded_roots(folders))
    assert rows(closed) == [("f2",), ("f3",), ("f4",), ("f6",)]
    assert fd.folder_estimate(folders, closed).first()["estimate"] == 180
    cyclic = folders.unionByName(spark.createDataFrame([("f2", "Deleted Items", "f4", 0)], folders.schema))
    assert fd.folder_closure(cyclic, fd.excluded_roots(cyclic)).distinct().count() == 4


# --- files ------------------------------------------------------------------------------


def record(mid, **over):
    base = {"messageId": mid, "threadId": "t", "sender": {"email": "a@x.org"}, "dateReceived": "2024-01-02T03:04:05.678Z", "isUnread": True}
    return base | over


def put(path: pathlib.Path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, indent=2))


def test_shards_in_name_order(spark, tmp_path):
    put(tmp_path / "batch-00002.json", [record("c")])
    put(tmp_path / "batch-00001.json", [record("a"), record("b", subject="", recipients={"to": ["x@y.org"], "cc": []})])
    put(tmp_path / "batch-000010.json", [record("z")])
    put(tmp_path / "batch-1.json", [record("ignored")])
    put(tmp_path / "notes.json", "{}")
    got = readers.read_messages(spark, str(tmp_path)).orderBy("ingest_seq").collect()
    names = sorted(["batch-00002.json", "batch-00001.json", "batch-000010.json"])
    ids = {"batch-00002.json": ["c"], "batch-00001.json": ["a", "b"], "batch-000010.json": ["z"]}
    assert [r["message_id"] for r in got] == [m for n in names for m in ids[n]]
    by_id = {r["message_id"]: r for r in got}
    assert by_id["a"]["subject"] == "(no subject)" and by_id["b"]["subject"] == ""
    assert by_id["a"]["category"] == "unknown" and by_id["a"]["labels"] == [] and by_id["b"]["recipients"]["to"] == ["x@y.org"]


@pytest.mark.parametrize(
    "content",
    [
        [record("a"), record("b", sender={"email": "nope"})],
        [record("")],
        [record("a", dateReceived="")],
        [record("a", gmailCategory="spam")],
        record("a"),
        '[{"messageId": "a"',
    ],
)
def test_one_bad_record_fails_the_load(spark, tmp_path, content):
    put(tmp_path / "batch-00001.json", content)
    with pytest.raises(Exception):  # noqa: B017
        readers.read_messages(spark, str(tmp_path)).collect()


def test_drop_mode_returns_rejects(spark, tmp_path):
    put(tmp_path / "batch-00001.json", [record("a"), record("")])
    assert rows(readers.read_messages(spark, str(tmp_path), mode="DROP"), "message_id") == [("a",)]
    assert readers.read_rejects(spark, str(tmp_path)).count() == 1


def test_backfills(spark, tmp_path):
    root = str(tmp_path)
    assert readers.load_all(spark, root).count() == 0
    put(tmp_path / "batch-00001.json", [record("a")])
    assert readers.read_backfill(spark, root).count() == 0
    for run, check in (("r1", {"runId": "r1", "status": "complete"}), ("r2", {"runId": "r2", "status": "failed"}), ("r3", "{broken"), ("r4", None)):
        put(tmp_path / "backfills" / run / "batch-00001.json", [record(run), record("a")])
        if check is not None:
            put(tmp_path / "backfills" / run / "backfill-checkpoint.json", check)
    got = readers.load_all(spark, root).orderBy("ingest_seq").collect()
    assert [r["message_id"] for r in got] == ["a", "r1", "a"]


def test_recovered_last_wins(spark, tmp_path):
    lines = [record("a", subject="one"), "{broken", record("b"), record("a", subject="two"), record("c", sender={"email": "x"})]
    put(tmp_path / "recovered.jsonl", "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n\n")
    got = readers.read_recovered(spark, str(tmp_path / "recovered.jsonl"))
    assert rows(got, "message_id", "subject") == [("a", "two"), ("b", "(no subject)")]


def test_lines_and_records_are_parsed_once(spark, tmp_path):
    """The checks of a record read the parsed record; they don't parse its text again, one check at a time."""
    put(tmp_path / "recovered.jsonl", json.dumps(record("a")))
    put(tmp_path / "batch-00001.json", [record("a"), record("b", sender={"email": "x"})])
    dropped = readers.read_messages(spark, str(tmp_path), "DROP")
    for read in (readers.read_recovered(spark, str(tmp_path / "recovered.jsonl")), dropped, readers.read_rejects(spark, str(tmp_path))):
        assert read._jdf.queryExecution().optimizedPlan().toString().count("from_json(") <= 1
        assert read.count() == 1


def test_shards_round_trip(spark, messages, tmp_path):
    mail = messages([{"email": f"u{i}@x.org", "labels": ["INBOX"] if i % 2 else []} for i in range(1234)])
    path = str(tmp_path / "out")
    writers.write_shards(mail, path)
    columns = [c for c in mail.columns if c != "ingest_seq"]
    back = readers.read_messages(spark, path)
    assert rows(back, *columns) == rows(mail, *columns)
    assert [r["message_id"] for r in back.orderBy("ingest_seq").collect()] == [f"m{i}" for i in range(1234)]
    assert spark.read.text(f"{path}/shard=*/*").count() == 3


def test_message_table_is_partitioned_by_month(spark, messages, tmp_path):
    path = str(tmp_path / "mail")
    writers.write_messages(messages([{"date": "2024-01-05 00:00:00"}, {"date": "2024-02-05 00:00:00", "labels": ["STARRED"]}]), path)
    table = spark.read.parquet(path)
    assert rows(table, "month", "in_inbox", "is_starred") == [("2024-01", True, False), ("2024-02", False, True)]


def test_state_log_manifest_rules_files(spark, tmp_path):
    assert readers.read_sender_state(spark, str(tmp_path / "none.json")) is None
    put(tmp_path / "state.json", {"version": 1, "mailbox": "me", "generatedAt": "2024-01-01T00:00:00.000Z", "senders": [{"senderEmail": "a@x.org", "emailCount": 2, "senderType": "human"}]})
    assert rows(readers.read_sender_state(spark, str(tmp_path / "state.json")), "mailbox", "sender_email", "sender_type") == [("me", "a@x.org", "human")]
    put(tmp_path / "corrupt.json", "{nope")
    with pytest.raises(Exception):  # noqa: B017
        readers.read_sender_state(spark, str(tmp_path / "corrupt.json")).collect()
    put(tmp_path / "log.json", {"version": 1, "decisions": [{"runId": "r", "senderEmail": s, "timestamp": "2024-01-01T00:00:00.000Z"} for s in ("b", "a")]})
    assert rows(readers.read_decisions(spark, str(tmp_path / "log.json")), "log_seq", "sender_email") == [(0, "b"), (1, "a")]
    put(tmp_path / "m.json", {"version": 1, "runId": "r", "batchId": "b", "status": "prepared", "summary": {"senderCount": 1}, "senders": [{"senderEmail": "a@x.org", "filterStatus": "pending"}]})
    senders, header = readers.read_manifest(spark, str(tmp_path / "m.json"))
    assert rows(senders, "batch_id", "position", "filter_status") == [("b", 1, "pending")] and header.first()["status"] == "prepared"
    put(tmp_path / "rules.json", '{"domainRules": {"X.org": "one", "x.ORG": "two"}, "senderRules": {"A@x.org": null}}')
    assert rows(readers.load_rules(spark, str(tmp_path / "rules.json"))) == [("domain", "x.org", "two"), ("sender", "a@x.org", None)]


def test_write_sender_state_checks_first(spark, tmp_path):
    path = str(tmp_path / "state")
    schema = "sender_email string, email_count long, thread_count long, starred_count long, important_count long, unread_ratio double, sample_subjects array<string>"
    good = spark.createDataFrame([("a@x.org", 1, 1, 0, 0, 0.5, ["s"])], schema)
    writers.write_sender_state(good, path)
    # The new state may derive from the table that it replaces.
    writers.write_sender_state(spark.read.schema(good.schema).parquet(path).withColumn("email_count", F.col("email_count") + 1), path)
    assert rows(spark.read.parquet(path), "email_count") == [(2,)]
    for bad in (good.withColumn("unread_ratio", F.lit(1.5)), good.unionByName(good.withColumn("sender_email", F.lit("A@X.org")))):
        with pytest.raises(ValueError):
            writers.write_sender_state(bad, path)
    assert rows(spark.read.parquet(path), "email_count") == [(2,)]


def test_report_and_audit_files(spark, tmp_path):
    lines = spark.createDataFrame([(1, "b"), (0, "a"), (2, "")], "section int, line string")
    writers.write_lines(lines, ["section"], str(tmp_path / "report"))
    files = sorted((tmp_path / "report").glob("part-*"))
    assert "".join(f.read_text() for f in files) == "a\nb\n\n"
    writers.write_audit(spark.createDataFrame([("a@x.org", "85%")], "sender_email string, unread_ratio string"), str(tmp_path / "audit"))
    back = spark.read.option("header", True).csv(str(tmp_path / "audit"))
    assert back.columns == ["sender_email", "unread_ratio"] and rows(back) == [("a@x.org", "85%")]


# --- streams ----------------------------------------------------------------------------


def test_restart_equals_one_run(spark, messages, tmp_path):
    src, dst, ckpt = (str(tmp_path / x) for x in ("src", "dst", "ckpt"))
    mail = messages([{} for _ in range(50)])
    for low, high in ((0, 20), (20, 50)):
        mail.filter(F.col("ingest_seq").between(low, high - 1)).write.mode("append").parquet(src)
        jobs.ingest_stream(spark, src, dst, ckpt).awaitTermination()
        jobs.ingest_stream(spark, src, dst, ckpt).awaitTermination()
    assert rows(spark.read.parquet(dst), "message_id") == rows(mail, "message_id")


def test_sweep_reads_decisions_of_each_run(spark, messages, tmp_path):
    src, log, dst, ckpt = (str(tmp_path / x) for x in ("src", "log", "dst", "ckpt"))

    def decide(seq, action):
        spark.createDataFrame([("a@x.org", action, seq)], "sender_email string, user_decision string, log_seq long").withColumn(
            "decided_at", F.to_timestamp(F.lit(f"2024-01-0{seq} 00:00:00"))
        ).write.mode("append").parquet(log)

    mail = messages([{"email": "a@x.org"} for _ in range(4)])
    for seq, action in ((1, "filter"), (2, "keep")):
        decide(seq, action)
        mail.filter(F.col("ingest_seq") % 2 == seq - 1).write.mode("append").parquet(src)
        jobs.sweep_stream(spark, src, log, dst, ckpt).awaitTermination()
    swept = spark.read.parquet(dst).select(F.explode("message_ids").alias("m"))
    assert rows(swept) == [("m0",), ("m2",)]


# --- recovery ---------------------------------------------------------------------------

ERRORS = [
    (0, "Message m1: bad", None, None),
    (1, "x", None, "m2"),
    (2, "x", "message", None),
    (3, "Message m3: bad", "system", None),
    (4, "quota", None, ""),
    (5, "Message m1: again", None, None),
]


def test_errors(spark):
    errors = spark.createDataFrame(ERRORS, "error_seq long, message string, kind string, message_id string")
    assert [r["level"] for r in bf.error_level(errors).orderBy("error_seq").collect()] == ["message", "message", "message", "system", "system", "message"]
    assert rows(bf.recovery_ids(errors)) == [("m1",), ("m2",), ("m3",)]
    staged = spark.createDataFrame([("m1", 1), ("m1", 2), ("other", 3)], "message_id string, ingest_seq long")
    residuals = spark.createDataFrame([(1, "m2"), (7, "m2"), (8, "m1"), (9, "zz")], "error_seq long, message_id string")
    merged = composed.backfill_merge(errors, staged, residuals)
    assert rows(merged["recovered"]) == [("m1", 2)]
    assert rows(merged["residual"], "message_id", "error_seq") == [("m2", 7)]
    assert rows(merged["errors"], "error_seq") == [(1,), (2,), (3,), (4,)]
    assert merged["report"].first().asDict() == {"recovered": 1, "targets": 3, "still_failing": 1, "shards": 1}


def test_fingerprint_is_one_value_at_any_size(spark):
    import hashlib

    def plain(ids):
        buckets = {}
        for h in sorted({hashlib.sha256(i.encode()).hexdigest() for i in ids}):
            buckets.setdefault(h[:4], []).append(h)
        digest = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
        return len(set(ids)), digest(f"{b}:{digest(hs)}" for b, hs in sorted(buckets.items()))

    for ids in ([], ["b", "a", "c", "a"], [f"m{i}" for i in range(100_001)]):
        df = spark.createDataFrame([(i,) for i in ids], "message_id string")
        assert rows(bf.fingerprint(df)) == [plain(ids)]


def test_pending_bodies(spark):
    ids, done, cache = (spark.createDataFrame([(x,) for x in s], "message_id string") for s in ("abcd", "abc", "bd"))
    assert rows(bf.pending_bodies(ids, done, cache)) == [("a",), ("c",), ("d",)]


# --- data quality -----------------------------------------------------------------------


def test_message_rules(messages):
    mail = messages([{"id": ""}, {"id": "m1", "email": "bad"}, {"id": "m2", "category": None}, {"id": "m3"}])
    assert rows(quality.check_messages(mail)) == [("", "message_id", ""), ("m1", "sender", "bad"), ("m2", "category", None)]


def test_stats_and_state_rules(spark):
    schema = "sender_email string, email_count long, thread_count long, starred_count long, important_count long, unread_ratio double, sample_subjects array<string>, sender_type string"
    data = [("a@x.org", -1, 0, 0, 0, 1.5, ["s"] * 6, "robot"), ("A@x.org", 1, 1, 0, 0, 1.0, ["s"] * 5, None)]
    df = spark.createDataFrame(data, schema)
    assert [r[1] for r in rows(quality.check_stats(df))] == ["email_count", "sample_subjects", "sender_type", "unread_ratio"]
    assert rows(quality.check_state(df)) == [("a@x.org", "unique_sender", "2")]


def test_classification_rules(spark):
    df = spark.createDataFrame(
        [("t", "c", 1.0, "x" * 500, "rule"), ("u", "", 1.1, "x" * 501, "me")], "thread_id string, category string, confidence double, summary string, classified_by string"
    )
    assert [(r[0], r[1]) for r in rows(quality.check_classifications(df))] == [("u", "category"), ("u", "classified_by"), ("u", "confidence"), ("u", "summary")]


# --- model interfaces -------------------------------------------------------------------


def test_parse_sender_results(spark):
    prompts = spark.createDataFrame([(1, ["A@x.org", "b@x.org"]), (2, ["c@x.org"]), (3, ["d@x.org"])], "prompt_no long, emails array<string>")
    entry = '{"email": "%s", "senderType": "%s", "confidence": %s}'
    good = "[" + ", ".join([entry % ("a@X.org", "human", 0.9), entry % ("a@x.org", "company", 0.8), entry % ("zz@x.org", "human", 1), entry % ("b@x.org", "robot", 1)]) + "]"
    responses = spark.createDataFrame(
        [(1, f"I say [1] and [oops] then {good} and [" + entry % ("b@x.org", "human", 1) + "]"), (2, "[" + entry % ("c@x.org", "human", 1.5) + "]"), (3, "")],
        "prompt_no long, response string",
    )
    assert rows(infer.parse_sender_results(responses, prompts), "email", "sender_type", "confidence") == [
        ("a@x.org", "human", 0.9),
        ("b@x.org", "unknown", 0.0),
        ("c@x.org", "unknown", 0.0),
        ("d@x.org", "unknown", 0.0),
    ]


def test_prompts_hold_fifty_senders_and_examples(spark):
    senders = spark.range(120).select(
        F.concat(F.lit("s"), "id", F.lit("@x.org")).alias("sender_email"),
        F.lit("n").alias("sender_name"),
        F.array(F.lit("subject")).alias("sample_subjects"),
        F.lit(3).alias("email_count"),
        F.lit("primary").alias("category"),
        F.lit(0.126).alias("unread_ratio"),
        F.lit(2).alias("thread_count"),
        F.col("id").alias("first_seq"),
    )
    examples = spark.createDataFrame(
        [("b@x.org", "human", "confirmed", 1), ("a@x.org", "company", "corrected", 2)], "sender_email string, sender_type string, context string, log_seq long"
    )
    got = infer.sender_prompts(senders, examples).orderBy("prompt_no").collect()
    assert [len(r["emails"]) for r in got] == [50, 50, 20]
    first = json.loads(got[0]["payload"])[0]
    assert (first["email"], first["domain"], first["unreadRatio"]) == ("s0@x.org", "x.org", 0.13)
    assert got[0]["instructions"].endswith("- a@x.org → company (corrected)\n- b@x.org → human (confirmed)")


def test_scorer_gets_one_retry(spark, tmp_path):
    prompts = spark.createDataFrame([(0, "i", "ok"), (1, "i", "flaky"), (2, "i", "dead")], "prompt_no long, instructions string, payload string").coalesce(1)
    log = tmp_path / "calls"

    def fn(instructions, payload):
        with log.open("a") as f:
            f.write(payload + "\n")
        calls = log.read_text().split().count(payload)
        if payload == "dead" or (payload == "flaky" and calls == 1):
            raise RuntimeError
        return payload + " answer"

    got = rows(infer.score_senders(prompts, fn))
    assert got == [(0, "ok answer"), (1, "flaky answer"), (2, "")]
    assert log.read_text().split().count("dead") == 2


def test_taxonomy(spark):
    sample = spark.createDataFrame([(2, "b"), (1, "a")], "first_seq long, summary string")
    assert rows(infer.propose_taxonomy(sample, lambda texts: texts)) == [("a",), ("b",)]

    def broken(texts):
        raise RuntimeError

    with pytest.raises(Exception, match="RuntimeError"):
        infer.propose_taxonomy(sample, broken).count()
