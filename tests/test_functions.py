from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mailsift.functions import address, measure, text


@pytest.mark.parametrize(
    "email",
    [
        "user=bounce@service.com",
        "user/dept@example.com",
        "user!important@example.com",
        "user#tag@example.com",
        "user%x@example.com",
        "bounced-123-user=example.com@bounce.service.com",
        "a@[10.0.0.1]",
    ],
)
def test_email_accepted(value, email):
    assert value(address.is_email(F.lit(email)))


@pytest.mark.parametrize(
    "email",
    ["not-an-email", "user@example", "user@localhost", "user..name@example.com", "user.@example.com", "", "a@b@c.com"],
)
def test_email_rejected(value, email):
    assert not value(address.is_email(F.lit(email)))


@pytest.mark.parametrize(
    ("raw", "email", "name"),
    [
        ("Sarah Johnson <sarah.johnson@gmail.com>", "sarah.johnson@gmail.com", "Sarah Johnson"),
        ('"Morning Brew" <newsletter@morning-brew.com>', "newsletter@morning-brew.com", "Morning Brew"),
        ("<shipping@cosyresi.com>", "shipping@cosyresi.com", ""),
        ("noreply@github.com", "noreply@github.com", ""),
        ("   Ann <  a@x.org > ", "a@x.org", "Ann"),
        ('"', '"', ""),
        ("x" * 201 + " <a@x.org>", "a@x.org", "x" * 201),
    ],
)
def test_from_header(value, raw, email, name):
    got = value(address.from_header(F.lit(raw)))
    assert (got["email"], got["name"]) == (email, name)


@pytest.mark.parametrize(
    ("raw", "addresses"),
    [
        ('"Doe, Jane" <jane@x.org>, bob@y.org', ["jane@x.org", "bob@y.org"]),
        ("a@x.org,,  ,b@x.org", ["a@x.org", "b@x.org"]),
        ('a@x.org, "open, b@x.org', ["a@x.org", '"open, b@x.org']),
        ('"a,b" <q@x.org>,"c,d" <r@x.org>', ["q@x.org", "r@x.org"]),
        ("", []),
    ],
)
def test_address_list(value, raw, addresses):
    assert value(address.address_list(F.lit(raw))) == addresses


def test_long_address_list_is_read_whole(value):
    raw = ", ".join(f"user{i}@example.org" for i in range(500))
    assert len(value(address.address_list(F.lit(raw)))) == 500


def test_header_first_with_value(spark):
    headers = [("subject", None), ("SUBJECT", "one"), ("Subject", "two")]
    df = spark.createDataFrame([(headers,)], "h array<struct<name:string,value:string>>")
    assert df.select(address.header("h", "Subject").alias("v")).first()["v"] == "one"
    assert df.select(address.header("h", "From").alias("v")).first()["v"] is None


@pytest.mark.parametrize(
    ("labels", "category"),
    [
        (["INBOX", "CATEGORY_SOCIAL", "CATEGORY_PROMOTIONS"], "social"),
        (["CATEGORY_PERSONAL"], "primary"),
        (["INBOX"], "unknown"),
        ([], "unknown"),
    ],
)
def test_infer_category(spark, labels, category):
    df = spark.createDataFrame([(labels,)], "l array<string>")
    assert df.select(address.infer_category("l").alias("v")).first()["v"] == category


@pytest.mark.parametrize(
    ("email", "host", "local"),
    [("A@B@C.com", "b@c.com", "a"), ("plain", "", "plain"), ("No-Reply@X.ORG", "x.org", "no-reply")],
)
def test_domain_and_local_part(value, email, host, local):
    assert value(address.domain(F.lit(email))) == host
    assert value(address.local_part(F.lit(email))) == local


def test_subdomains(value):
    inside = lambda h: value(address.in_domains(F.lit(h), ["mailchimp.com"]))
    assert inside("mailchimp.com") and inside("r.mailchimp.com") and not inside("notmailchimp.com")


def test_trim_all(value):
    assert value(address.trim_all(F.lit("﻿ \t a b \r\n"))) == "a b"


BODIES = [
    ("Hello there.\n> This is a quoted line.\n> Another.\nSee you soon.", "Hello there.\nSee you soon."),
    ("My reply.\n\nOn Mon, Jan 1, 2026 at 10:00 AM Alice Smith <a@x.org> wrote:\n> Old", "My reply.\n"),
    ("My reply.\n\nOn Jan 1, 2026, at 10:00, Alice Smith <a@x.org> wrote:\n> Old", "My reply.\n"),
    ("My reply.\nFrom: Alice\nSent: Monday\nTo: Bob\nold", "My reply."),
    ("New content.\n---------- Forwarded message ----------\nOld content.", "New content."),
    ("Plain text.\nWith lines.", "Plain text.\nWith lines."),
    (">text without blank\n>\n> quoted", ">text without blank\n>"),
    ("> " + "q" * 520 + "\nend", "end"),
    ("-----\nfive dashes stay", "-----\nfive dashes stay"),
    ("On it wrote:\nold", ""),
    ("", ""),
]


@pytest.mark.parametrize(("body", "kept"), BODIES)
def test_unique_content(value, body, kept):
    assert value(text.unique_content(F.lit(body))) == kept


def test_unique_content_reads_long_bodies_whole(value):
    body = "\n".join(f"line {i}" for i in range(20_000)) + "\n> quoted\nlast"
    assert value(text.unique_content(F.lit(body))).endswith("\nline 19999\nlast")


def test_strip_html(value):
    assert value(text.strip_html(F.lit("<p>Hi</p>  <b>you</b>\t\tthere"))) == "Hi you there"


@pytest.mark.parametrize(
    ("raw", "payload"),
    [
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ("```\n[1]\n```", "[1]"),
        (' {"a": 1} ', '{"a": 1}'),
        ("no json", None),
    ],
)
def test_json_payload(value, raw, payload):
    assert value(text.json_payload(F.lit(raw))) == payload


def test_legacy_message_id(value):
    assert value(text.legacy_message_id(F.lit("Message abc: bad"))) == "abc"
    assert value(text.legacy_message_id(F.lit("A Message abc: bad"))) is None


def test_decode_body(value):
    assert value(text.decode_body(F.lit("R3LDvMOfZT8_"))) == "Grüße??"
    assert value(text.decode_body(F.lit("_w"))) == "�"


def test_numbers_and_dates(value):
    assert value(measure.whole_percent(F.lit(0.945))) == 95
    assert value(measure.two_decimals(F.lit(0.126))) == 0.13
    assert value(measure.thousands(F.lit(1234567))) == "1,234,567"
    moment = F.lit("2024-03-05 06:07:08.009").cast("timestamp_ntz")
    assert value(measure.iso_instant(moment)) == "2024-03-05T06:07:08.009Z"
    assert value(measure.query_date(moment)) == "2024/03/05"
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    assert value(measure.within_days(at("2023-02-15 00:00:00"), "2024-02-15 00:00:00"))
    assert not value(measure.within_days(at("2023-02-14 23:59:59"), dt.datetime(2024, 2, 15)))


def test_arrival_order_is_fixed_width_and_ordered(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (timestamp'2024-01-01', 5L), (timestamp'2024-01-01', 4L), (timestamp'1960-01-01', 9L) AS t(d, s)"
    )
    got = [r["s"] for r in df.orderBy(measure.arrival_order("d", "s")).collect()]
    assert got == [9, 4, 5]
