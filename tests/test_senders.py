from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from mailsift.operators import scoring, senders, state
from mailsift.plans import composed

AS_OF = "2024-02-15 00:00:00"


def test_hundred_mails_of_ten_senders(messages):
    data = [
        {"email": f"s{i % 10}@x.org", "thread": f"t{i}", "unread": i % 20 < 10, "date": f"2024-01-{i // 10 + 1:02d} 00:00:00"}
        for i in range(100)
    ]
    got = senders.sender_stats(messages(data)).collect()
    assert len(got) == 10
    assert all((r["email_count"], r["unread_ratio"], r["thread_count"]) == (10, 0.5, 10) for r in got)
    assert all(len(r["sample_subjects"]) == 5 for r in got)


def test_stats_details(messages):
    data = [
        {"email": "A@x.org", "name": "Old", "date": "2024-01-01 00:00:00", "category": "social", "subject": "one"},
        {"email": "a@X.org", "name": "", "date": "2024-01-05 00:00:00", "category": "updates", "subject": "two", "labels": ["STARRED"]},
        {"email": "a@x.org", "name": "New", "date": "2024-01-03 00:00:00", "category": "updates", "subject": "one"},
        {"email": "a@x.org", "name": "Tie", "date": "2024-01-03 00:00:00", "category": "social", "subject": "three"},
    ]
    got = senders.sender_stats(messages(data)).first()
    assert got["sender_email"] == "a@x.org"
    assert got["sender_name"] == "Tie"  # latest non-empty; of equal dates the later row
    assert got["category"] == "social"  # tie: seen first
    assert got["sample_subjects"] == ["two", "one", "three"]
    assert got["starred_count"] == 1


def test_stats_do_not_depend_on_partitioning(messages):
    data = [
        {"email": f"s{i % 3}@x.org", "name": f"n{i % 4}", "category": ["social", "forums"][i % 2], "date": f"2024-01-0{i % 5 + 1} 00:00:00", "subject": f"s{i % 7}"}
        for i in range(60)
    ]
    df = messages(data)
    assert rows(senders.sender_stats(df.repartition(7, "subject"))) == rows(senders.sender_stats(df.coalesce(1)))


def stats(spark, **over):
    base = {
        "sender_email": "ann@x.org",
        "sender_name": "",
        "email_count": 50,
        "last_email_date": "2024-02-10 00:00:00",
        "category": "primary",
        "unread_ratio": 0.5,
        "thread_count": 20,
        "starred_count": 0,
        "important_count": 0,
        "sample_subjects": ["hello"],
        "first_seq": 0,
    }
    row = base | over
    schema = (
        "sender_email string, sender_name string, email_count long, last_email_date string, category string, unread_ratio double, "
        "thread_count long, starred_count long, important_count long, sample_subjects array<string>, first_seq long"
    )
    extra = {k: v for k, v in row.items() if k not in base}
    df = spark.createDataFrame([tuple(row[k] for k in base)], schema)
    df = df.withColumn("last_email_date", F.to_timestamp("last_email_date"))
    for name, item in extra.items():
        df = df.withColumn(name, F.lit(item))
    return df


@pytest.mark.parametrize(
    ("over", "dialect", "tier", "action"),
    [
        ({"sender_email": "NoReply@x.org"}, "gmail", "definitely_noise", "unsubscribe"),
        ({"sender_email": "noreply@x.org", "email_count": 1}, "gmail", "definitely_noise", "unsubscribe"),
        ({"sender_email": "noreply2@x.org"}, "gmail", "definitely_keep", "keep"),
        ({"sender_email": "a@r.mailchimp.com"}, "gmail", "definitely_noise", "unsubscribe"),
        ({"sender_email": "a@notmailchimp.com"}, "gmail", "definitely_keep", "keep"),
        ({"sender_email": "a@eu.hubspot.com"}, "gmail", "definitely_noise", "unsubscribe"),
        ({"sender_email": "a@eu.hubspot.com"}, "o365", "probably_keep", "keep"),
        ({"email_count": 1, "unread_ratio": 1.0}, "gmail", "probably_keep", "keep"),
        (
            {"unread_ratio": 1.0, "category": "promotions", "thread_count": 1, "last_email_date": "2022-01-01 00:00:00", "sender_type": "automated"},
            "gmail",
            "definitely_noise",
            "unsubscribe",
        ),
        ({"unread_ratio": 1.0, "category": "updates", "thread_count": 3, "sender_type": "human"}, "gmail", "probably_noise", "filter"),
    ],
)
def test_tiers(spark, over, dialect, tier, action):
    got = scoring.score_confidence(stats(spark, **over), AS_OF, dialect).first()
    assert (got["confidence_tier"], got["recommended_action"]) == (tier, action)


@pytest.mark.parametrize(
    ("unread", "count", "flag"), [(0.81, 21, True), (0.8, 21, False), (0.81, 20, False), (0.9, 100, True)]
)
def test_surprise_flag_bounds(spark, unread, count, flag):
    got = scoring.score_confidence(stats(spark, unread_ratio=unread, email_count=count), AS_OF).first()
    assert got["surprises_flag"] is flag


def test_age_bounds_are_inclusive(spark):
    def score(date):
        return scoring.score_confidence(stats(spark, last_email_date=date), AS_OF).first()["noise_score"]

    assert score("2023-11-17 00:00:00") < score("2023-11-16 23:59:59")
    assert score("2023-02-15 00:00:00") < score("2023-02-14 23:59:59")


@pytest.mark.parametrize(
    ("over", "kind", "confidence"),
    [
        ({"sender_email": "digest@x.org"}, "automated", 0.95),
        ({"sender_email": "jane@gmail.com", "sender_name": "Jane Doe", "email_count": 10, "thread_count": 8}, "human", 1.0),
        ({"sender_email": "x@corp.com", "sender_name": "Acme Team", "email_count": 10, "thread_count": 5}, "unknown", 0.5),
        # Newsletter words rule out the corporate vote.
        ({"sender_email": "x@corp.com", "sender_name": "Team Newsletter", "email_count": 100, "thread_count": 5}, "newsletter", 0.7),
        ({"sender_email": "support@corp.com", "sender_name": "Weekly", "email_count": 100, "thread_count": 5}, "newsletter", 0.7),
        ({"sender_email": "news@corp.com", "sender_name": "news", "email_count": 100, "thread_count": 5}, "automated", 0.8),
        ({"sender_email": "x@corp.com", "sender_name": "Ärzte Team", "email_count": 10, "thread_count": 5}, "unknown", 0.5),
    ],
)
def test_heuristic_types(spark, over, kind, confidence):
    got = scoring.classify_heuristic(stats(spark, **over)).first()
    assert got["heuristic_type"] == kind
    assert got["heuristic_confidence"] == pytest.approx(confidence)


def test_subject_votes(spark):
    subjects = ["Your order #1", "Weekly digest", "Re: you", "hello"]
    got = scoring.classify_heuristic(
        stats(spark, sender_email="x@corp.com", sender_name="The Digest", sample_subjects=subjects, email_count=10, thread_count=5)
    ).first()
    assert (got["heuristic_type"], got["heuristic_confidence"]) == ("newsletter", 0.75)


@pytest.mark.parametrize(
    ("over", "wanted"),
    [
        ({"email_count": 2, "thread_count": 2, "unread_ratio": 0.0}, False),
        ({"email_count": 10, "thread_count": 10, "unread_ratio": 0.0, "sender_type": "human"}, True),
        ({"email_count": 10, "thread_count": 0, "unread_ratio": 1.0, "sender_type": "human"}, False),
    ],
)
def test_extraction(spark, over, wanted):
    over = {"sender_type": "unknown"} | over
    assert scoring.score_extraction(stats(spark, **over)).first()["extraction_candidate"] is wanted


FRESH = "sender_email string, sender_type string, sender_type_confidence double, sender_type_source string, extraction_candidate boolean"
STORED = FRESH + ", reviewed_sender_type string, user_decision string"


@pytest.mark.parametrize(
    ("fresh", "stored", "dialect", "want"),
    [
        # A user's type wins, the reviewed one first.
        (("company", 0.9, "llm", None), ("human", 0.4, "user", True, "newsletter", "keep"), "gmail", ("newsletter", 0.4, "user", True, "newsletter", None)),
        (("company", 0.9, "llm", None), ("human", None, "user", None, None, "keep"), "o365", ("human", None, "user", None, None, "keep")),
        # Of two model types the more confident one; the stored one when equal.
        (("company", 0.7, "llm", False), ("human", 0.7, "llm", True, None, None), "gmail", ("human", 0.7, "llm", False, None, None)),
        (("company", 0.8, "llm", None), ("human", 0.7, "llm", True, None, None), "gmail", ("company", 0.8, "llm", True, None, None)),
        (("company", None, "llm", None), ("human", None, "llm", None, None, None), "gmail", ("human", None, "llm", None, None, None)),
        # Otherwise stored values fill what fresh lacks.
        ((None, None, None, None), ("human", 0.7, "heuristic", True, None, "filter"), "gmail", ("human", 0.7, "heuristic", True, None, None)),
        (("company", None, None, None), ("human", 0.7, "heuristic", True, None, "filter"), "o365", ("company", 0.7, "heuristic", True, None, "filter")),
    ],
)
def test_merge_truth_table(spark, fresh, stored, dialect, want):
    f = spark.createDataFrame([("a@x.org", *fresh)], FRESH)
    s = spark.createDataFrame([("A@X.org", *stored), ("gone@x.org", *stored)], STORED)
    got = state.merge_state(f, s, dialect).collect()
    assert len(got) == 1
    columns = ("sender_type", "sender_type_confidence", "sender_type_source", "extraction_candidate", "reviewed_sender_type", "user_decision")
    assert tuple(got[0][c] for c in columns) == want


def test_enrich_order(spark):
    jane = stats(spark, sender_email="jane@gmail.com", sender_name="Jane Doe", email_count=10, thread_count=8)
    user = stats(spark, sender_email="u@corp.com", sender_name="x", email_count=10, thread_count=5)
    vague = stats(spark, sender_email="v@corp.com", sender_name="x", email_count=10, thread_count=5)
    lost = stats(spark, sender_email="w@corp.com", sender_name="x", email_count=10, thread_count=5)

    def reviewed(df, value):
        return df.withColumn("reviewed_sender_type", F.lit(value).cast("string"))

    everyone = reviewed(jane, None).unionByName(reviewed(user, "company")).unionByName(reviewed(vague, None)).unionByName(reviewed(lost, None))
    results = spark.createDataFrame(
        [("V@corp.com", "newsletter", 0.8), ("jane@gmail.com", "automated", 1.0)], "email string, sender_type string, confidence double"
    )
    got = rows(composed.enrich(everyone, results), "sender_email", "sender_type", "sender_type_confidence", "sender_type_source")
    assert got == [
        ("jane@gmail.com", "human", 1.0, "heuristic"),
        ("u@corp.com", "company", None, "user"),
        ("v@corp.com", "newsletter", 0.8, "llm"),
        ("w@corp.com", "unknown", 0.0, None),
    ]
    assert rows(composed.ambiguous_senders(everyone), "sender_email") == [("v@corp.com",), ("w@corp.com",)]
