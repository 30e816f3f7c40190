from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from mailsift.operators import review
from mailsift.operators.senders import review_batches, type_breakdown
from mailsift.operators.state import apply_review, contact_links, identity_links, rescore_candidates
from mailsift.plans import reports

NOW = "2024-02-16 08:00:00"


@pytest.fixture
def manifest(spark):
    data = [
        ("A@x.org", "Ann", 1200, 0.945, "human", None, "keep", 1),
        ("b@x.org", "Bob", 30, 0.5, "company", "newsletter", "filter", 2),
        ("c@x.org", "Cat", 10, 0.25, "company", "company", "unsubscribe", 3),
    ]
    schema = (
        "sender_email string, sender_name string, email_count long, unread_ratio double, presented_sender_type string, "
        "reviewed_sender_type string, user_decision string, position int"
    )
    df = spark.createDataFrame(data, schema).withColumn("run_id", F.lit("r1")).withColumn("batch_id", F.lit("b1"))
    return review.initial_manifest(df.withColumn("system_recommendation", F.lit("keep")))


def test_initial_manifest_and_summary(manifest):
    assert all(r["filter_status"] == "pending" and r["messages_archived"] == 0 for r in manifest.collect())
    got = review.batch_summary(manifest).first()
    assert (got["sender_count"], got["total_email_count"]) == (3, 1240)
    assert got["average_unread_ratio"] == pytest.approx(0.565)


def test_pending_steps(manifest):
    def outcomes(**options):
        return {(r["sender_email"], r["step"]): r["outcome"] for r in review.pending_steps(manifest, **options).collect()}

    default = outcomes()
    assert len(default) == 15
    assert default["b@x.org", "filter_status"] == "skipped"
    assert default["A@x.org", "archive_status"] == "skipped" and default["b@x.org", "archive_status"] == "done"
    assert default["A@x.org", "log_status"] == "done"
    filtering = outcomes(skip_filters=False)
    assert filtering["b@x.org", "filter_status"] == "done" and filtering["A@x.org", "filter_status"] == "skipped"
    done = manifest.withColumn("filter_status", F.lit("done"))
    assert review.pending_steps(done).count() == 12


def test_decision_entries_are_logged_once(manifest, spark):
    worked = manifest.withColumn("filter_applied", F.col("user_decision") == "filter").withColumn("messages_archived", F.lit(4))
    empty = spark.createDataFrame([], "run_id string, batch_id string, sender_email string")
    entries = review.decision_entries(worked, empty, NOW)
    got = {r["sender_email"]: (r["feedback"], r["actions_taken"]) for r in entries.collect()}
    assert got == {
        "A@x.org": ("none", []),
        "b@x.org": ("corrected", ["filter", "archive"]),
        "c@x.org": ("confirmed", ["archive"]),
    }
    assert review.decision_entries(worked, entries, NOW).count() == 0


def test_apply_review(manifest, spark):
    state = spark.createDataFrame(
        [("a@x.org", "human", 0.9, "llm"), ("B@x.org", "company", 0.9, "llm"), ("z@x.org", "company", 0.9, "llm")],
        "sender_email string, sender_type string, sender_type_confidence double, sender_type_source string",
    )
    got = {r["sender_email"]: r for r in apply_review(state, manifest, NOW).collect()}
    assert got["a@x.org"]["sender_type_source"] == "llm" and got["a@x.org"]["processed_at"] is not None
    b = got["B@x.org"]
    assert (b["sender_type"], b["sender_type_source"], b["sender_type_confidence"]) == ("newsletter", "user", None)
    assert got["z@x.org"]["processed_at"] is None


def test_audit_round(manifest, spark):
    state = spark.createDataFrame(
        [("a@x.org", "Ann", 1200, 0.945, 3, ["x", "y"], True, None), ("z@x.org", "Zed", 1, 0.0, 1, [], None, "human")],
        "sender_email string, sender_name string, email_count long, unread_ratio double, thread_count long, sample_subjects array<string>, "
        "extraction_candidate boolean, sender_type string",
    )
    for name in ("first_email_date", "last_email_date"):
        state = state.withColumn(name, F.to_timestamp(F.lit("2024-01-02 03:04:05.678")))
    state = state.withColumn("category", F.lit("primary"))
    audit = review.audit_rows(state)
    got = {r["sender_email"]: r for r in audit.collect()}
    ann, zed = got["a@x.org"], got["z@x.org"]
    assert len(audit.columns) == 16
    assert (ann["unread_ratio"], ann["sample_subjects"], ann["extraction_candidate"]) == ("95%", "x | y", "Yes")
    assert ann["first_email_date"] == "2024-01-02T03:04:05.678Z"
    assert (zed["extraction_candidate"], zed["sender_type"], zed["surprises_flag"], zed["confidence_tier"]) == ("", "human", "No", "")
    assert review.audit_rows(state, "o365").filter("sender_email = 'a@x.org'").first()["unread_ratio"] == 0.945
    assert review.audit_sheet(audit).columns[:2] == ["Sender email", "Sender name"]

    updated = {r["sender_email"]: r for r in review.update_audit(audit, manifest, NOW).collect()}
    assert (updated["a@x.org"]["user_decision"], updated["a@x.org"]["sender_type"], updated["a@x.org"]["processed"]) == ("keep", "human", "2024-02-16")
    assert updated["z@x.org"]["processed"] == ""
    problems = rows(review.validate_manifest(manifest, state, audit))
    assert problems == [(e, r) for e in ("b@x.org", "c@x.org") for r in ("audit", "state")]


def test_audit_decisions(spark):
    audit = spark.createDataFrame(
        [(" a@x.org ", " Keep", 1), ("a@x.org", "FILTER", 2), ("A@x.org", "keep", 3), ("b@x.org", "  ", 4), ("b@x.org", None, 5), ("c@x.org", "maybe", 6), ("", "keep", 7)],
        "sender_email string, user_decision string, row_no long",
    )
    decisions, invalid = review.read_audit_decisions(audit)
    assert rows(decisions) == [("A@x.org", "keep"), ("a@x.org", "filter")]
    assert rows(invalid) == [("c@x.org", "maybe")]


def triage(messages):
    return messages(
        [
            {"id": "m1", "thread": "t1", "email": "b@x.org", "subject": "S1", "labels": ["_triage", "INBOX", "L1", "L2"]},
            {"id": "m2", "thread": "t1", "email": "z@x.org", "labels": ["_triage", "L2"]},
            {"id": "m3", "thread": "t2", "email": "a@x.org", "labels": ["_triage", "Hidden"]},
            {"id": "t2", "thread": "t3", "email": "B@x.org", "labels": ["_triage", "custom"]},
        ]
    )


def names(spark):
    return spark.createDataFrame([("L1", "_private"), ("L2", "Bills"), ("Hidden", "ALL_CAPS")], "label_id string, name string")


def test_triage_items(spark, messages):
    got = {r["thread_id"]: r for r in review.triage_items(review.triage_queue(triage(messages)), names(spark)).collect()}
    assert {k: v["category"] for k, v in got.items()} == {"t1": "Bills", "t2": "uncategorized", "t3": "custom"}
    assert (got["t1"]["representative_id"], got["t1"]["message_count"]) == ("m1", 2)


def test_action_order_is_collated(spark):
    items = spark.createDataFrame([("c", "B", "", "1"), ("c", "a", "", "2"), ("b", "z", "", "3")], "category string, sender_email string, subject string, thread_id string")
    assert [r["thread_id"] for r in review.order_action_items(items).collect()] == ["3", "2", "1"]


@pytest.mark.parametrize(
    ("decisions", "outcomes"),
    [
        ([("t1", "star"), ("m3", "archive")], {"t1": "ok", "m3": "ok"}),
        ([("m1", "star"), ("m2", "star")], {"m1": "ok", "m2": "ok"}),
        ([("m1", "star"), ("t1", "archive")], {"m1": "conflicting", "t1": "conflicting"}),
        ([("t2", "star")], {"t2": "ambiguous"}),  # a thread, and a message of another thread
        ([("nope", "star")], {"nope": "unknown"}),
    ],
)
def test_resolve_decisions(spark, messages, decisions, outcomes):
    asked = spark.createDataFrame(decisions, "review_id string, decision string")
    resolved = review.resolve_decisions(asked, triage(messages))
    assert {r["review_id"]: r["outcome"] for r in resolved.collect()} == outcomes
    if set(outcomes.values()) != {"ok"}:
        with pytest.raises(ValueError):
            review.finalize_plan(asked, triage(messages))


def test_finalize_plan(spark, messages):
    asked = spark.createDataFrame([("t1", "star"), ("m3", "archive")], "review_id string, decision string")
    plan = {r["decision"]: r for r in review.finalize_plan(asked, triage(messages)).collect()}
    assert (plan["star"]["message_ids"], plan["star"]["add_labels"], plan["star"]["remove_labels"]) == (["m1", "m2"], ["STARRED"], ["_triage"])
    assert (plan["archive"]["message_ids"], plan["archive"]["remove_labels"]) == (["m3"], ["INBOX", "_triage"])
    counts = review.review_counts(review.resolve_decisions(asked, triage(messages))).first()
    assert (counts["starred"], counts["archived"]) == (1, 1)


def test_brief(manifest):
    headers = manifest.select("run_id", "batch_id", "status").distinct().select(
        "*", F.lit("human").alias("batch_type"), F.lit("by type").alias("grouping_reason"), F.lit("keep").alias("presented_recommendation"), F.lit("2024-02-16T08:00:00.000Z").alias("created_at")
    )
    lines = [r["line"] for r in reports.brief_lines(manifest, headers).orderBy(*reports.ORDER).collect()]
    assert lines[0] == "# Batch Brief: b1" and lines[4] == "**Status:** prepared"
    assert "- **Total emails:** 1,240" in lines and "- **Average unread ratio:** 56%" in lines
    first = lines.index("## Senders") + 2
    assert lines[first] == "1. **A@x.org** (Ann) — 1,200 emails, 95% unread — decision: **keep**"
    assert lines[first + 3 :] == [
        "",
        "## Type Corrections",
        "",
        "- **b@x.org**: company → newsletter",
        "",
        "> **Safety note:** If this brief conflicts with the JSON manifest, the manifest wins.",
        "",
    ]


def test_action_report(spark, messages):
    items = review.triage_items(triage(messages), names(spark))
    lines = [r["line"] for r in reports.action_lines(items, NOW).orderBy(*reports.action_order()).collect()]
    assert lines[:2] == ["# Action Pass Report — 2024-02-16", ""]
    start = lines.index("## Bills")
    assert lines[start + 1 : start + 4] == ["", "- **From:** b@x.org", "  **Subject:** S1"]
    empty = reports.action_lines(items.limit(0), NOW).orderBy(*reports.action_order()).collect()
    assert [r["line"] for r in empty][-1] == "No actionable items to review."


def test_review_batches_and_breakdown(spark):
    state = spark.createDataFrame(
        [(f"s{i:03d}@x.org", "newsletter" if i < 70 else None, i % 9) for i in range(80)], "sender_email string, sender_type string, email_count long"
    )
    got = review_batches(state, size=50).collect()
    news = sorted((r["position"], r["batch_no"], r["email_count"]) for r in got if r["sender_type"] == "newsletter")
    assert [p for p, _, _ in news] == list(range(1, 71))
    assert [b for _, b, _ in news] == [1] * 50 + [2] * 20
    assert [n for _, _, n in news] == sorted((n for _, _, n in news), reverse=True)
    assert rows(type_breakdown(state)) == [("automated", 0), ("company", 0), ("human", 0), ("newsletter", 70), ("unknown", 10)]


def test_rescore_candidates(spark):
    state = spark.createDataFrame(
        [("a@x.org", "unknown", 0.9), ("b@x.org", "human", 0.69), ("c@x.org", "human", 0.7), ("d@x.org", None, None), ("e@x.org", "unknown", 0.0)],
        "sender_email string, sender_type string, sender_type_confidence double",
    )
    open_batches = spark.createDataFrame([("executing", "E@x.org"), ("completed", "a@x.org")], "status string, sender_email string")
    assert rows(rescore_candidates(state, open_batches), "sender_email") == [("a@x.org",), ("b@x.org",), ("d@x.org",)]


def test_contacts(spark):
    contacts = spark.createDataFrame(
        [
            (1, "Ann", [("A@x.org", "home"), ("ann@y.org", "work"), ("a@X.org", "dup")], [("1", "m"), ("2", "h")]),
            (2, "Bob", [], []),
            (3, "John", [("ann@y.org", "home")], None),
            (4, "John", [("z@x.org", "home")], []),
        ],
        "contact_id long, name string, emails array<struct<value:string,type:string>>, phones array<struct<value:string,type:string>>",
    )
    state = spark.createDataFrame(
        [("a@x.org", 5, "human", "2024-01-01"), ("ann@y.org", 7, "company", "2023-01-01"), ("z@x.org", 1, "human", "2024-01-01")],
        "sender_email string, email_count long, sender_type string, last_email_date string",
    )
    assert rows(contact_links(contacts, state), "name", "sender_email") == [
        ("Ann", "a@x.org"), ("Ann", "ann@y.org"), ("John", "ann@y.org"), ("John", "z@x.org")
    ]
    got = identity_links(contacts, state).collect()
    assert sorted(tuple(r) for r in got) == [
        (1, "Ann", "1,2", 2, 12, "2024-01-01", "company"),
        (3, "John", "", 1, 7, "2023-01-01", "company"),
        (4, "John", "", 1, 1, "2024-01-01", "human"),
    ]
