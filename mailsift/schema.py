"""Declared schemas and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
CATEGORIES = ["primary", "social", "promotions", "updates", "forums", "unknown"]
SENDER_TYPES = ["human", "company", "newsletter", "automated", "unknown"]
TYPE_SOURCES = ["heuristic", "llm", "user"]
TIERS = ["definitely_noise", "probably_noise", "probably_keep", "definitely_keep"]
ACTIONS = ["keep", "filter", "unsubscribe"]
FEEDBACK = ["none", "confirmed", "corrected"]
STEP_STATUSES = ["pending", "done", "skipped"]
LOG_STEP_STATUSES = ["pending", "done"]
MANIFEST_STATUSES = ["prepared", "executing", "completed", "failed"]
CLASSIFIED_BY = ["rule", "llm", "fallback"]
NOISE_ACTIONS = ["filter", "unsubscribe"]
NOISE_LABEL = "_noise"
TRIAGE_LABEL = "_triage"
INBOX = "INBOX"
UNREAD = "UNREAD"
STARRED = "STARRED"
IMPORTANT = "IMPORTANT"

_text = T.StringType()
_texts = T.ArrayType(T.StringType())

MESSAGE = T.StructType(
    [
        T.StructField("message_id", _text),
        T.StructField("thread_id", _text),
        T.StructField("sender", T.StructType([T.StructField("email", _text), T.StructField("name", _text)])),
        T.StructField("recipients", T.StructType([T.StructField("to", _texts), T.StructField("cc", _texts)])),
        T.StructField("subject", _text),
        T.StructField("date_received", T.TimestampType()),
        T.StructField("category", _text),
        T.StructField("labels", _texts),
        T.StructField("is_unread", T.BooleanType()),
        T.StructField("snippet", _text),
        T.StructField("ingest_seq", T.LongType()),
    ]
)

# Field names of the JSON shards at the edge.
MESSAGE_JSON = T.StructType(
    [
        T.StructField("messageId", _text),
        T.StructField("threadId", _text),
        T.StructField("sender", T.StructType([T.StructField("email", _text), T.StructField("name", _text)])),
        T.StructField("recipients", T.StructType([T.StructField("to", _texts), T.StructField("cc", _texts)])),
        T.StructField("subject", _text),
        T.StructField("dateReceived", _text),
        T.StructField("gmailCategory", _text),
        T.StructField("labels", _texts),
        T.StructField("isUnread", T.BooleanType()),
        T.StructField("snippet", _text),
    ]
)

HEADERS = T.ArrayType(T.StructType([T.StructField("name", _text), T.StructField("value", _text)]))


def mime_part(depth: int) -> T.StructType:
    """Schema of a MIME part with ``depth`` further levels below it."""
    fields = [
        T.StructField("mimeType", _text),
        T.StructField("headers", HEADERS),
        T.StructField("body", T.StructType([T.StructField("data", _text)])),
    ]
    if depth > 0:
        fields.append(T.StructField("parts", T.ArrayType(mime_part(depth - 1))))
    return T.StructType(fields)


# Levels of MIME parts in the declared schema, counted from the payload; mail nests a handful.
MIME_DEPTH = 40

RAW_GMAIL = T.StructType(
    [
        T.StructField("id", _text),
        T.StructField("threadId", _text),
        T.StructField("labelIds", _texts),
        T.StructField("snippet", _text),
        T.StructField("historyId", _text),
        T.StructField("internalDate", _text),
        T.StructField("payload", mime_part(MIME_DEPTH)),
    ]
)

_address = T.StructType(
    [T.StructField("emailAddress", T.StructType([T.StructField("address", _text), T.StructField("name", _text)]))]
)

RAW_GRAPH = T.StructType(
    [
        T.StructField("id", _text),
        T.StructField("conversationId", _text),
        T.StructField("from", _address),
        T.StructField("toRecipients", T.ArrayType(_address)),
        T.StructField("ccRecipients", T.ArrayType(_address)),
        T.StructField("subject", _text),
        T.StructField("receivedDateTime", _text),
        T.StructField("categories", _texts),
        T.StructField("isRead", T.BooleanType()),
        T.StructField("parentFolderId", _text),
        T.StructField("bodyPreview", _text),
        T.StructField("flag", T.StructType([T.StructField("flagStatus", _text)])),
        T.StructField("importance", _text),
    ]
)

SENDER_STATE_JSON = T.StructType(
    [
        T.StructField("senderEmail", _text),
        T.StructField("senderName", _text),
        T.StructField("emailCount", T.LongType()),
        T.StructField("firstEmailDate", _text),
        T.StructField("lastEmailDate", _text),
        T.StructField("gmailCategory", _text),
        T.StructField("unreadRatio", T.DoubleType()),
        T.StructField("threadCount", T.LongType()),
        T.StructField("sampleSubjects", _texts),
        T.StructField("starredCount", T.LongType()),
        T.StructField("importantCount", T.LongType()),
        T.StructField("confidenceTier", _text),
        T.StructField("recommendedAction", _text),
        T.StructField("surprisesFlag", T.BooleanType()),
        T.StructField("userDecision", _text),
        T.StructField("senderType", _text),
        T.StructField("senderTypeConfidence", T.DoubleType()),
        T.StructField("senderTypeSource", _text),
        T.StructField("extractionCandidate", T.BooleanType()),
        T.StructField("reviewedSenderType", _text),
        T.StructField("reviewedAt", _text),
        T.StructField("processedAt", _text),
    ]
)

DECISION_JSON = T.StructType(
    [
        T.StructField("runId", _text),
        T.StructField("senderEmail", _text),
        T.StructField("senderName", _text),
        T.StructField("presentedSenderType", _text),
        T.StructField("reviewedSenderType", _text),
        T.StructField("senderTypeFeedback", _text),
        T.StructField("systemRecommendation", _text),
        T.StructField("userDecision", _text),
        T.StructField("batchId", _text),
        T.StructField("timestamp", _text),
        T.StructField("emailCount", T.LongType()),
        T.StructField("messagesArchived", T.LongType()),
        T.StructField("actionsTaken", _texts),
    ]
)

MANIFEST_SENDER_JSON = T.StructType(
    [
        T.StructField("senderEmail", _text),
        T.StructField("senderName", _text),
        T.StructField("emailCount", T.LongType()),
        T.StructField("unreadRatio", T.DoubleType()),
        T.StructField("lastEmailDate", _text),
        T.StructField("presentedSenderType", _text),
        T.StructField("reviewedSenderType", _text),
        T.StructField("systemRecommendation", _text),
        T.StructField("userDecision", _text),
        T.StructField("filterApplied", T.BooleanType()),
        T.StructField("filterStatus", _text),
        T.StructField("archiveStatus", _text),
        T.StructField("logStatus", _text),
        T.StructField("stateStatus", _text),
        T.StructField("sheetStatus", _text),
        T.StructField("messagesArchived", T.LongType()),
        T.StructField("lastError", _text),
    ]
)

MANIFEST_JSON = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("runId", _text),
        T.StructField("batchId", _text),
        T.StructField("batchType", _text),
        T.StructField("groupingReason", _text),
        T.StructField("presentedRecommendation", _text),
        T.StructField(
            "summary",
            T.StructType(
                [
                    T.StructField("senderCount", T.LongType()),
                    T.StructField("totalEmailCount", T.LongType()),
                    T.StructField("averageUnreadRatio", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("status", _text),
        T.StructField("createdAt", _text),
        T.StructField("senders", T.ArrayType(MANIFEST_SENDER_JSON)),
    ]
)

PULL_ERROR = T.StructType(
    [
        T.StructField("timestamp", _text),
        T.StructField("message", _text),
        T.StructField("pageToken", _text),
        T.StructField("kind", _text),
        T.StructField("messageId", _text),
    ]
)
