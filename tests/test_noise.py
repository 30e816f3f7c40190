from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from mailsift.operators import decisions as dc
from mailsift.operators import filters as fl
from mailsift.operators import noise

LOG = (
    "run_id string, batch_id string, sender_email string, presented_type string, reviewed_type string, "
    "user_decision string, decided_at string, messages_archived long, log_seq long"
)


def log(spark, *data):
    df = spark.createDataFrame(list(data), LOG)
    return df.withColumn("decided_at", F.to_timestamp("decided_at")).withColumn("actions_taken", F.array(F.lit("filter")))


@pytest.fixture
def decisions(spark):
    return log(
        spark,
        ("r1", "b1", "A@x.org", "human", None, "filter", "2024-01-01 00:00:00", 3, 0),
        ("r1", "b1", " a@x.org ", "human", "human", "keep", "2024-01-02 00:00:00", 0, 1),
        ("r2", "b1", "a@x.org", "human", "newsletter", "unsubscribe", "2024-01-02 00:00:00", 5, 2),  # equal time: first stays
        ("r1", "b1", "b@x.org", "company", None, "unsubscribe", "2024-01-01 00:00:00", 7, 3),
        ("r1", "b2", "c@x.org", "company", "company", "filter", "2024-01-01 00:00:00", 9, 4),
        ("r1", "b2", "C@x.org", "company", "human", "filter", "2023-01-01 00:00:00", 2, 5),
    )


def test_latest_decisions(decisions):
    got = rows(dc.latest_decisions(decisions), "sender_key", "user_decision", "log_seq")
    assert got == [("a@x.org", "keep", 1), ("b@x.org", "unsubscribe", 3), ("c@x.org", "filter", 4)]
    assert rows(dc.noise_senders(decisions)) == [("b@x.org", "unsubscribe"), ("c@x.org", "filter")]
    assert [r["sender_key"] for r in dc.order_noise(dc.noise_senders(decisions)).collect()] == ["c@x.org", "b@x.org"]


def test_run_dashboard(spark, decisions):
    senders = spark.range(2)
    got = dc.run_dashboard(decisions, "r1", senders).first().asDict()
    # The keys are lower case only, so the padded address counts by itself.
    assert got == {
        "processed": 4,
        "emails_cleared": 3 + 0 + 7 + 2,
        "unsubscribed": 1,
        "senders_filtered": 4,
        "total_senders": 2,
        "remaining": 0,
    }


def test_upsert_replaces_in_place(decisions, spark):
    entry = log(spark, ("r1", "b1", "B@x.org", "company", None, "keep", "2024-03-01 00:00:00", 0, 6), ("r9", "b1", "b@x.org", "company", None, "keep", "2024-03-01 00:00:00", 0, 7))
    got = rows(dc.upsert_decisions(decisions, entry).filter("lower(sender_email) = 'b@x.org'"), "run_id", "user_decision", "log_seq")
    assert got == [("r1", "keep", 3), ("r9", "keep", 7)]
    assert rows(dc.not_yet_logged(entry, decisions), "run_id") == [("r9",)]


def test_few_shot(decisions):
    got = [tuple(r) for r in dc.few_shot(dc.with_feedback(decisions), 3).collect()]
    assert got == [
        ("a@x.org", "newsletter", "corrected", 2),
        ("C@x.org", "human", "corrected", 5),
        (" a@x.org ", "human", "confirmed", 1),
    ]
    with pytest.raises(ValueError):
        dc.few_shot(dc.with_feedback(decisions), 0)


def test_sweep_is_idempotent(messages, decisions):
    """A swept mailbox has nothing left to sweep."""
    mail = messages([{"email": e, "labels": ["INBOX"] if i % 3 else []} for i in range(20) for e in ("B@x.org", "d@x.org", "a@x.org")])
    plan = noise.sweep_plan(mail, decisions, size=5)
    swept = plan.select(F.explode("message_ids").alias("message_id"))
    assert swept.count() == 13 and plan.count() == 3
    after = mail.join(swept.withColumn("hit", F.lit(True)), "message_id", "left").withColumn(
        "labels", F.when(F.col("hit"), F.array(F.lit("_noise"))).otherwise(F.col("labels"))
    )
    assert noise.sweep_plan(after, decisions).count() == 0


def test_scope(messages):
    mail = messages([{"id": name, "labels": [name, "X"]} for name in ("SPAM", "TRASH", "DRAFT", "SENT", "INBOX")] + [{"id": "none", "labels": []}])
    assert rows(noise.in_scope(mail), "message_id") == [("INBOX",), ("none",)]


def test_caps(messages, spark):
    mail = messages([{"id": f"m{i}", "email": "a@x.org" if i % 5 else f"b{i}@x.org"} for i in range(50)])
    senders = mail.select(F.col("sender.email").alias("sender_key"))
    capped = noise.cap_per_sender(mail, senders, max_messages=7, max_senders=3)
    got = {r["sender_key"]: (r["n"], r["t"]) for r in capped.groupBy("sender_key").agg(F.count("*").alias("n"), F.max("truncated").alias("t")).collect()}
    assert got == {"a@x.org": (7, True), "b0@x.org": (1, False), "b10@x.org": (1, False)}
    assert noise.cap_per_sender(mail, senders).count() == 50
    with pytest.raises(ValueError):
        noise.cap_per_sender(mail, senders, max_messages=0)


def test_archive_plan_chunks(messages):
    mail = messages([{"email": "a@x.org"} for _ in range(25)])
    senders = mail.select(F.col("sender.email").alias("sender_key"))
    assert sorted(r["ids"] for r in noise.archive_plan(mail, senders, size=10).collect()) == [5, 10, 10]


def test_filter_plan(decisions):
    got = {r["from_addr"]: r["remove_labels"] for r in noise.filter_plan(decisions).collect()}
    assert got == {"b@x.org": ["INBOX", "UNREAD"], "c@x.org": ["INBOX"]}


def test_noise_category_is_a_set(messages):
    mail = messages([{"labels": ["Red", "_noise", "Red"]}, {"labels": []}])
    got = [r["merged_labels"] for r in noise.add_noise_category(mail).orderBy("ingest_seq").collect()]
    assert got == [["Red", "_noise"], ["_noise"]]


def test_covered_by_rule(spark):
    rules = [
        (True, ["A@x.org", "b@x.org"], "f1", ["_noise"], {}),
        (False, ["c@x.org"], "f1", ["_noise"], {}),
        (True, ["d@x.org"], "f2", ["_noise"], {}),
        (True, ["e@x.org"], "f1", ["Red"], {}),
        (True, ["f@x.org"], "f1", ["_noise"], {"subjectContains": '["x"]'}),
        (True, ["g@x.org"], "f1", ["_noise"], {"subjectContains": "[]", "hasAttachments": "false", "x": None, "y": '" "'}),
        (True, None, "f1", ["_noise"], {}),
    ]
    schema = "is_enabled boolean, sender_contains array<string>, move_to_folder string, assign_categories array<string>, other_conditions map<string,string>"
    senders = spark.createDataFrame([(f"{c}@x.org",) for c in "abcdefg"], "sender_email string")
    got = rows(noise.covered_by_rule(spark.createDataFrame(rules, schema), senders, "f1"), "sender_email")
    assert got == [("a@x.org",), ("b@x.org",), ("g@x.org",)]


def live(spark, *data):
    return spark.createDataFrame(list(data), "filter_id string, from_addr string, query string, add_labels array<string>, remove_labels array<string>")


@pytest.fixture
def filters(spark):
    return live(
        spark,
        ("f1", "C@x.org", None, ["_noise"], ["INBOX"]),
        ("f2", "b@x.org", None, ["_noise", "_noise"], ["UNREAD", "INBOX"]),
        ("f3", "a@x.org", None, ["_noise"], ["INBOX"]),
        ("f4", "b@x.org", None, ["_noise"], ["INBOX", "STARRED"]),
        ("f5", None, "from:z", ["_noise"], ["INBOX"]),
        ("f6", "b@x.org", None, None, ["INBOX"]),
    )


def test_classify_filters(filters, decisions):
    got = rows(fl.classify_filters(filters, decisions), "filter_id", "kind")
    assert got == [("f1", "legacy-noise"), ("f2", "legacy-noise"), ("f3", "stale-keep"), ("f4", "other"), ("f5", "other"), ("f6", "other")]


def test_consolidation_and_reconcile(spark, filters, decisions):
    plan = fl.consolidation_plan(filters, decisions)
    assert rows(plan["creates"], "action", "query") == [("filter", "from:c@x.org"), ("unsubscribe", "from:b@x.org")]
    assert rows(plan["deletes"], "filter_id") == [("f1",), ("f2",), ("f3",)]
    summary = fl.migration_summary(plan).first()
    assert (summary["created"], summary["deleted"], summary["slots_freed"], summary["headroom"], summary["over_limit"]) == (2, 3, 1, 995, False)
    assert fl.migration_summary(plan, delete_first=True).first()["headroom"] == 997

    # Half done: the unsubscribe filter exists with its labels in another order.
    half = filters.filter("filter_id NOT IN ('f1', 'f2')").unionByName(live(spark, ("n1", None, "from:b@x.org", ["_noise"], ["UNREAD", "INBOX"])))
    step = fl.reconcile(plan, half).first()
    assert (step["remaining_deletes"], step["remaining_creates"], step["satisfied"]) == (1, 1, False)

    # Done: running the same plan again leaves nothing to do.
    done = half.filter("filter_id <> 'f3'").unionByName(live(spark, ("n2", None, "from:c@x.org", ["_noise"], ["INBOX"])))
    assert fl.reconcile(plan, done).first()["satisfied"]
