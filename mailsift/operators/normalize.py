"""Raw messages of the two dialects into the message table, with rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.functions.address import NO_SUBJECT, address_list, from_header, header, infer_category, is_email
from mailsift.functions.text import decode_body, strip_html
from mailsift.ranking import computed_once
from mailsift.schema import IMPORTANT, INBOX, MESSAGE, MIME_DEPTH, STARRED, UNREAD

SCHEMA_FAILURE = "Schema validation failed"


def _blank(c: Column) -> Column:
    return F.coalesce(c == "", F.lit(True))


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def _checked(parsed: DataFrame) -> DataFrame:
    """The parsed messages, with the reason of those that are rejected."""
    valid = (
        is_email("sender.email")
        & F.forall("recipients.to", is_email)
        & F.forall("recipients.cc", is_email)
        & F.col("date_received").isNotNull()
    )
    return computed_once(
        parsed.withColumn("reason", F.coalesce("reason", F.when(~F.coalesce(valid, F.lit(False)), SCHEMA_FAILURE)))
    )


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, rejects) of a parsed table; write it down first if both are used, as parsing is costly."""
    messages = checked.filter(F.col("reason").isNull()).select(*MESSAGE.fieldNames())
    rejects = checked.filter(F.col("reason").isNotNull()).select(F.col("message_id").alias("id"), "reason")
    return messages, rejects


def normalize_gmail(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, rejects) of Gmail-shaped raw messages with an ``ingest_seq``."""
    return split(parse_gmail(raw))


def parse_gmail(raw: DataFrame) -> DataFrame:
    """Gmail-shaped raw messages in the columns of the message table, with a reason where one is rejected."""
    headers = F.col("payload.headers")
    # Header values are looked up once; all parsing below works on plain text columns.
    values = computed_once(
        raw.select(
            F.col("id").alias("message_id"),
            F.col("threadId").alias("thread_id"),
            "internalDate",
            F.coalesce("labelIds", _no_texts()).alias("labels"),
            F.coalesce("snippet", F.lit("")).alias("snippet"),
            F.col("payload").isNull().alias("no_payload"),
            *[header(headers, name).alias(f"{name.lower()}_text") for name in ("From", "To", "Cc", "Subject")],
            "ingest_seq",
        )
    )
    reason = (
        F.when(_blank(F.col("message_id")), "Missing message id")
        .when(_blank(F.col("thread_id")), "Missing threadId")
        .when(_blank(F.col("internalDate")), "Missing internalDate")
        .when(F.col("no_payload"), "Missing payload")
        .when(F.col("from_text").isNull(), "Missing From header")
    )

    def listed(name: str) -> Column:
        return F.coalesce(address_list(name), _no_texts())

    parsed = values.select(
        "message_id",
        "thread_id",
        from_header("from_text").alias("sender"),
        F.struct(listed("to_text").alias("to"), listed("cc_text").alias("cc")).alias("recipients"),
        F.coalesce("subject_text", F.lit(NO_SUBJECT)).alias("subject"),
        F.timestamp_millis(F.col("internalDate").try_cast("bigint")).alias("date_received"),
        infer_category("labels").alias("category"),
        "labels",
        F.array_contains("labels", UNREAD).alias("is_unread"),
        "snippet",
        "ingest_seq",
        reason.alias("reason"),
    )
    return _checked(parsed)


def graph_labels(inbox_id: str | Column) -> Column:
    """Labels of a Graph message: inbox, unread, starred, important, then its categories."""
    inbox = inbox_id if isinstance(inbox_id, Column) else F.lit(inbox_id)
    flags = F.array_compact(
        F.array(
            F.when(F.col("parentFolderId") == inbox, INBOX),
            F.when(F.col("isRead") == F.lit(False), UNREAD),
            F.when(F.col("flag.flagStatus") == "flagged", STARRED),
            F.when(F.col("importance") == "high", IMPORTANT),
        )
    )
    own = F.filter(F.coalesce("categories", _no_texts()), lambda c: F.coalesce(c != "", F.lit(False)))
    return F.concat(flags, own)


def graph_recipients(name: str) -> Column:
    """Lower-cased addresses of a recipient list; entries without an address drop out."""
    addresses = F.transform(F.col(name), lambda r: F.lower(r["emailAddress"]["address"]))
    kept = F.filter(addresses, lambda a: F.coalesce(a != "", F.lit(False)))
    return F.coalesce(kept, _no_texts())


def normalize_graph(raw: DataFrame, inbox_id: str | Column) -> tuple[DataFrame, DataFrame]:
    """(messages, rejects) of Graph-shaped raw messages with an ``ingest_seq``."""
    return split(parse_graph(raw, inbox_id))


def parse_graph(raw: DataFrame, inbox_id: str | Column) -> DataFrame:
    """Graph-shaped raw messages in the columns of the message table, with a reason where one is rejected."""
    address = F.col("from.emailAddress.address")

    def filled(name: str, default: Column) -> Column:
        return F.when(_blank(F.col(name)), default).otherwise(F.col(name))

    reason = (
        F.when(_blank(F.col("id")), "Missing id")
        .when(F.col("from").isNull(), "Missing from")
        .when(_blank(address), "Missing from address")
    )
    parsed = raw.select(
        F.col("id").alias("message_id"),
        filled("conversationId", F.col("id")).alias("thread_id"),
        F.struct(
            F.lower(address).alias("email"), F.coalesce("from.emailAddress.name", F.lit("")).alias("name")
        ).alias("sender"),
        F.struct(graph_recipients("toRecipients").alias("to"), graph_recipients("ccRecipients").alias("cc")).alias(
            "recipients"
        ),
        filled("subject", F.lit(NO_SUBJECT)).alias("subject"),
        F.try_to_timestamp("receivedDateTime").alias("date_received"),
        F.lit("unknown").alias("category"),
        graph_labels(inbox_id).alias("labels"),
        (~F.coalesce("isRead", F.lit(False))).alias("is_unread"),
        F.coalesce("bodyPreview", F.lit("")).alias("snippet"),
        "ingest_seq",
        reason.alias("reason"),
    )
    return _checked(parsed)


def _leaves(node: Column, levels: int) -> Column:
    """Text leaves below a MIME part in document order, as array<struct<mime, data>>."""
    mime = node["mimeType"]
    leaf = F.struct(mime.alias("mime"), node["body"]["data"].alias("data"))
    none = F.array().cast("array<struct<mime:string,data:string>>")
    found = F.when(mime.isin("text/plain", "text/html"), F.array(leaf))
    if levels > 0:
        below = F.flatten(F.transform(node["parts"], lambda part: _leaves(part, levels - 1)))
        found = found.when(mime.startswith("multipart/"), F.coalesce(below, none))
    return found.otherwise(none)


def _levels(part: T.StructType) -> int:
    """Levels of MIME parts that a schema holds below this one."""
    return 1 + _levels(part["parts"].dataType.elementType) if "parts" in part.fieldNames() else 0


def extract_bodies(raw: DataFrame) -> DataFrame:
    """(message_id, body): the first plain text leaf, even if empty, else the first HTML leaf as text.

    Looks as deep as the schema of ``payload`` goes, at most ``MIME_DEPTH`` levels.
    """
    depth = min(MIME_DEPTH, _levels(raw.schema["payload"].dataType))
    found = F.coalesce(_leaves(F.col("payload"), depth), F.array())
    leaves = computed_once(raw.select(F.col("id").alias("message_id"), found.alias("_l")))

    def first(mime: str) -> Column:
        return F.try_element_at(F.filter("_l", lambda leaf: leaf["mime"] == mime), F.lit(1))

    plain, html = first("text/plain"), first("text/html")
    body = F.when(plain.isNotNull(), decode_body(plain["data"])).when(
        html.isNotNull(), strip_html(decode_body(html["data"]))
    )
    return leaves.select("message_id", F.coalesce(body, F.lit("")).alias("body"))
