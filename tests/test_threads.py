from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from mailsift.operators import labels as lb
from mailsift.operators import threads as th
from mailsift.plans import composed, reports

AS_OF = "2024-02-15 00:00:00"
RULES = [
    ("sender", "help@chase.com", "banking"),
    ("sender", "open@gmail.com", None),
    ("domain", "chase.com", "finance"),
    ("domain", "gmail.com", "personal"),
    ("domain", "null.org", None),
]


@pytest.fixture
def rules(spark):
    return spark.createDataFrame(RULES, "kind string, rule_key string, category string")


def thread(spark, *data):
    df = spark.createDataFrame(list(data), "thread_id string, sender_email string, last_date string, first_seq long")
    return df.withColumn("last_date", F.to_timestamp("last_date"))


def test_collapse(spark, messages):
    data = [
        {"id": "m2", "thread": "t", "email": "bob@x.org", "subject": "Re: hi", "date": "2024-01-02 00:00:00"},
        {"id": "m1", "thread": "t", "email": "alice@x.org", "subject": "hi", "date": "2024-01-01 00:00:00"},
        {"id": "m3", "thread": "t", "email": "alice@x.org", "subject": "end", "date": "2024-01-03 00:00:00"},
        {"id": "m4", "thread": "u", "email": "carl@x.org"},
    ]
    bodies = spark.createDataFrame(
        [("m1", "  Hello \n> old"), ("m2", "> only quoted"), ("m3", "Bye\n\nOn Monday A wrote:\nHello")], "message_id string, body string"
    )
    df = messages(data)
    got = {r["thread_id"]: r for r in th.collapse_threads(df).collect()}
    t = got["t"]
    assert (t["sender_email"], t["subject"], t["message_count"], t["participants"]) == ("alice@x.org", "hi", 3, 2)
    people = rows(th.thread_participants(df).filter("thread_id = 't'"), "first_seq", "participant", "messages")
    assert people == [(0, "bob@x.org", 1), (1, "alice@x.org", 2)]
    entries = rows(th.thread_entries(df, bodies), "thread_id", "position", "message_id", "content")
    assert entries == [("t", 1, "m1", "Hello"), ("t", 2, "m2", ""), ("t", 3, "m3", "Bye"), ("u", 1, "m4", "")]


@pytest.mark.parametrize("size", [1999, 2000, 2001, 6000])
def test_threads_of_any_length_have_one_shape(spark, messages, size):
    """Equal dates are told apart by the sequence."""
    data = [{"id": f"m{i:05d}", "thread": "hot", "email": f"u{i % 90}@x.org", "date": f"2024-01-01 00:00:{i % 50:02d}"} for i in range(size)]
    df = messages(data)
    bodies = df.select("message_id", F.concat(F.lit("text "), "message_id").alias("body"))
    (head,) = th.collapse_threads(df).collect()
    assert (head["message_count"], head["participants"]) == (size, 90)
    entries = th.thread_entries(df, bodies).orderBy("position").collect()
    want = sorted(range(size), key=lambda i: (i % 50, i))
    assert [(r["position"], r["message_id"], r["content"]) for r in entries] == [
        (n + 1, f"m{i:05d}", f"text m{i:05d}") for n, i in enumerate(want)
    ]


def test_thread_heads_match_collapse(messages):
    data = [{"thread": f"t{i % 5}", "email": f"u{i % 3}@x.org", "date": f"2024-01-0{i % 4 + 1} 00:00:00"} for i in range(40)]
    df = messages(data)
    columns = ["thread_id", "sender_email", "subject", "first_date", "last_date", "message_count", "first_seq"]
    assert rows(th.thread_heads(df), *columns) == rows(th.collapse_threads(df), *columns)


def test_rules(spark, rules):
    threads = thread(
        spark,
        ("t1", "Help@Chase.com ", "2024-02-01 00:00:00", 1),
        ("t2", "a@chase.com", "2023-02-15 00:00:00", 2),
        ("t3", "open@gmail.com", "2024-02-01 00:00:00", 3),  # sender rule without category: no fall through
        ("t4", "b@gmail.com", "2023-02-14 23:59:59", 4),
        ("t5", "x@null.org", "2024-02-01 00:00:00", 5),
        ("t6", "malformed", "2024-02-01 00:00:00", 6),
    )
    got = rows(th.classify_rules(threads, rules, AS_OF), "thread_id", "category", "actionable", "rule_name")
    assert got == [
        ("t1", "banking", True, "sender:help@chase.com"),
        ("t2", "finance", True, "domain:chase.com"),
        ("t4", "personal", False, "domain:gmail.com"),
    ]


def test_results_and_single_pass_agree(spark, rules):
    threads = thread(
        spark,
        ("t1", "help@chase.com", "2024-02-01 00:00:00", 1),
        ("t3", "open@gmail.com", "2024-02-01 00:00:00", 3),
        ("t4", "x@y.org", "2022-01-01 00:00:00", 4),
        ("t5", "z@y.org", "2024-02-01 00:00:00", 5),
    )
    results = spark.createDataFrame(
        [("t1", "wrong", 0.1, True, "s"), ("t3", "kept", 0.9, True, "s"), ("t4", "old", 0.8, True, "s")],
        "thread_id string, category string, confidence double, actionable boolean, summary string",
    )
    by_rule = th.classify_rules(threads, rules, AS_OF)
    two_steps = th.all_classifications(by_rule, th.apply_thread_results(th.unmatched_threads(threads, by_rule), results, AS_OF))
    one_pass = th.classify_all(threads, rules, results, AS_OF)
    assert rows(one_pass) == rows(two_steps)
    got = {r["thread_id"]: r for r in one_pass.collect()}
    assert got["t1"]["category"] == "banking" and got["t1"]["classified_by"] == "rule"
    assert got["t3"]["actionable"] and not got["t4"]["actionable"]
    assert (got["t5"]["category"], got["t5"]["confidence"], got["t5"]["summary"]) == ("uncategorized", 0.0, "Classification failed.")


@pytest.mark.parametrize("partitions", ["1", "10"])
def test_only_failing_threads_fall_back(spark, messages, rules, partitions):
    data = [{"id": f"m{i}", "thread": f"t{i // 2}", "email": f"u{i}@y.org"} for i in range(40)]
    data.append({"id": "m40", "thread": "ruled", "email": "help@chase.com"})
    bodies = spark.createDataFrame([(f"m{i}", f"text {i}") for i in range(40)], "message_id string, body string")

    def scorer(thread: pd.DataFrame, categories: list[str]) -> pd.DataFrame:
        assert len(thread) == 1
        if thread["thread_id"][0] in ("t3", "t7"):
            raise RuntimeError("model is down")
        if thread["thread_id"][0] == "t5":
            return thread.head(0)
        return thread.assign(category="x", confidence=0.5, actionable=True, summary=thread["content"] + "|" + ",".join(categories))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        run = composed.run_classification(messages(data), bodies, rules, scorer, AS_OF)
        got = {r["thread_id"]: r for r in run["classifications"].collect()}
        errors = dict(rows(run["errors"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 21
    assert {t for t, r in got.items() if r["category"] == "uncategorized"} == {"t3", "t5", "t7"}
    assert got["t4"]["summary"] == "text 8\n\ntext 9|banking" and got["ruled"]["classified_by"] == "rule"
    assert errors == {"t3": "RuntimeError: model is down", "t7": "RuntimeError: model is down", "t5": "no result"}


def test_rules_template(spark):
    stats = spark.createDataFrame([(" A@X.org ",), ("b@x.org",), ("  ",), ("plain",)], "sender_email string")
    got = rows(th.rules_template(stats), "kind", "rule_key")
    assert got == [("domain", "x.org"), ("sender", "A@X.org"), ("sender", "b@x.org"), ("sender", "plain")]


def test_label_plan(spark, messages):
    mail = messages([{"id": f"m{i}", "thread": f"t{i % 3}"} for i in range(30)])
    classified = spark.createDataFrame(
        [("t0", "bills", True), ("t1", "bills", False), ("t2", "none", False), ("t9", "bills", True)],
        "thread_id string, category string, actionable boolean",
    )
    labels = spark.createDataFrame([("bills", "L1"), ("_triage", "L2")], "name string, label_id string")
    plan = lb.label_plan(classified, mail, labels, size=4).orderBy("action", "chunk_no").collect()
    assert [(r["action"], len(r["message_ids"])) for r in plan] == [(a, n) for a in ("archive", "triage") for n in (4, 4, 2)]
    assert {(r["action"], tuple(r["add_labels"]), tuple(r["remove_labels"])) for r in plan} == {
        ("archive", ("L1",), ("INBOX",)),
        ("triage", ("L1", "L2"), ()),
    }
    failures = lb.label_failures(classified, mail, labels)
    assert rows(failures, "thread_id", "reason") == [("t2", "no label"), ("t9", "no messages")]
    summary = lb.apply_summary(lb.label_plan(classified, mail, labels), failures).first()
    assert summary.asDict() == {"applied": 20, "archived": 10, "triaged": 10, "failures": 2}


def test_triage_without_triage_label(spark, messages):
    classified = spark.createDataFrame([("t0", "bills", True)], "thread_id string, category string, actionable boolean")
    labels = spark.createDataFrame([("bills", "L1")], "name string, label_id string")
    plan = lb.label_plan(classified, messages([{"thread": "t0"}]), labels).first()
    assert plan["add_labels"] == ["L1"]


def test_digest_lines(spark, messages, rules):
    data = [
        {"thread": "t0", "email": "a@chase.com", "subject": "Bill", "date": "2024-02-01 00:00:00"},
        {"thread": "t1", "email": "b@y.org", "subject": "Hi", "date": "2024-02-02 00:00:00"},
        {"thread": "t2", "email": "c@chase.com", "subject": "Two", "date": "2024-02-02 00:00:00"},
        {"thread": "t3", "email": "d@y.org", "labels": ["SPAM"], "date": "2024-02-02 00:00:00"},
        {"thread": "t4", "email": "e@y.org", "date": "2024-01-01 00:00:00"},
    ]
    results = spark.createDataFrame([], "thread_id string, category string, confidence double, actionable boolean, summary string")
    digest = composed.digest(messages(data), rules, results, "2024-01-25 00:00:00", AS_OF)
    lines = [r["line"] for r in reports.digest_lines(digest, AS_OF).orderBy(*reports.ORDER).collect()]
    assert lines == [
        "# Daily Digest — 2024-02-15",
        "",
        "**Total new messages:** 3",
        "**Auto-categorized threads:** 3",
        "**Actionable threads:** 2",
        "",
        "## Categories",
        "- finance: 2 threads",
        "- uncategorized: 1 thread",
        "",
        "## Actionable Items",
        "- **a@chase.com** — Bill",
        "- **c@chase.com** — Two",
        "",
    ]


def test_empty_digest(messages, spark, rules):
    results = spark.createDataFrame([], "thread_id string, category string, confidence double, actionable boolean, summary string")
    digest = composed.digest(messages([{"date": "2024-01-01 00:00:00"}]), rules, results, "2024-01-25 00:00:00", AS_OF)
    lines = [r["line"] for r in reports.digest_lines(digest, AS_OF).orderBy(*reports.ORDER).collect()]
    assert lines == ["# Daily Digest — 2024-02-15", "", "No new mail"]
