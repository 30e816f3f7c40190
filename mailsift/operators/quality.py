"""Data quality: one row (key, rule, value) per violation, found in one pass per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.address import is_email, sender_key
from mailsift.schema import (
    ACTIONS,
    CATEGORIES,
    CLASSIFIED_BY,
    FEEDBACK,
    LOG_STEP_STATUSES,
    MANIFEST_STATUSES,
    SENDER_TYPES,
    STEP_STATUSES,
    TIERS,
    TYPE_SOURCES,
)


def violations(df: DataFrame, key: Column, rules: dict[str, tuple[Column, Column | str]]) -> DataFrame:
    """Rows that break a rule; ``rules`` maps a name to (holds, value to report).

    A rule that evaluates to NULL is broken.
    """
    checks = []
    for name, (holds, value) in rules.items():
        value = F.col(value) if isinstance(value, str) else value
        broken = F.struct(F.lit(name).alias("rule"), value.cast("string").alias("value"))
        checks.append(F.when(~F.coalesce(holds, F.lit(False)), broken))
    rows = df.select(key.cast("string").alias("key"), F.explode(F.array_compact(F.array(*checks))).alias("_v"))
    return rows.select("key", "_v.rule", "_v.value")


def _filled(name: str):
    return F.col(name) != "", name


def _one_of(name: str, values: list[str], optional: bool = False):
    holds = F.col(name).isin(values)
    return (F.col(name).isNull() | holds if optional else holds), name


def _between(name: str, low, high=None, optional: bool = False):
    holds = F.col(name) >= low
    if high is not None:
        holds = holds & (F.col(name) <= high)
    return (F.col(name).isNull() | holds if optional else holds), name


def _known(df: DataFrame, rules: dict) -> dict:
    """Rules on columns that the table has; optional columns may be missing."""
    return {k: v for k, v in rules.items() if not isinstance(v[1], str) or v[1].split(".")[0] in df.columns}


def check_messages(messages: DataFrame) -> DataFrame:
    return violations(
        messages,
        F.col("message_id"),
        {
            "message_id": _filled("message_id"),
            "thread_id": _filled("thread_id"),
            "sender": (is_email("sender.email"), "sender.email"),
            "to": (F.forall("recipients.to", is_email), F.array_join("recipients.to", ",")),
            "cc": (F.forall("recipients.cc", is_email), F.array_join("recipients.cc", ",")),
            "category": _one_of("category", CATEGORIES),
            "date_received": (F.col("date_received").isNotNull(), "date_received"),
            "is_unread": (F.col("is_unread").isNotNull(), "is_unread"),
        },
    )


def check_stats(stats: DataFrame) -> DataFrame:
    rules = {
        "sender_email": _filled("sender_email"),
        "email_count": _between("email_count", 0),
        "thread_count": _between("thread_count", 0),
        "starred_count": _between("starred_count", 0),
        "important_count": _between("important_count", 0),
        "unread_ratio": _between("unread_ratio", 0, 1),
        "sample_subjects": (F.size("sample_subjects") <= 5, F.size("sample_subjects")),
        "confidence_tier": _one_of("confidence_tier", TIERS, optional=True),
        "recommended_action": _one_of("recommended_action", ACTIONS, optional=True),
        "user_decision": _one_of("user_decision", ACTIONS, optional=True),
        "sender_type": _one_of("sender_type", SENDER_TYPES, optional=True),
        "sender_type_source": _one_of("sender_type_source", TYPE_SOURCES, optional=True),
        "sender_type_confidence": _between("sender_type_confidence", 0, 1, optional=True),
    }
    return violations(stats, F.col("sender_email"), _known(stats, rules))


def _repeated(df: DataFrame, key: Column, rule: str) -> DataFrame:
    counts = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return counts.select("key", F.lit(rule).alias("rule"), F.col("_n").cast("string").alias("value"))


def check_state(state: DataFrame) -> DataFrame:
    """A sender occurs once, ignoring case."""
    return _repeated(state, sender_key("sender_email"), "unique_sender")


def check_log(decisions: DataFrame) -> DataFrame:
    rules = {
        "run_id": _filled("run_id"),
        "batch_id": _filled("batch_id"),
        "sender_email": _filled("sender_email"),
        "presented_type": _one_of("presented_type", SENDER_TYPES),
        "reviewed_type": _one_of("reviewed_type", SENDER_TYPES, optional=True),
        "feedback": _one_of("feedback", FEEDBACK),
        "user_decision": _one_of("user_decision", ACTIONS),
        "messages_archived": _between("messages_archived", 0),
        "corrected_needs_type": ((F.col("feedback") != "corrected") | F.col("reviewed_type").isNotNull(), "feedback"),
    }
    return violations(decisions, F.col("sender_email"), _known(decisions, rules))


def check_manifest(manifest: DataFrame) -> DataFrame:
    rules = {
        "run_id": _filled("run_id"),
        "batch_id": _filled("batch_id"),
        "sender_email": _filled("sender_email"),
        "email_count": _between("email_count", 0),
        "unread_ratio": _between("unread_ratio", 0, 1),
        "presented_sender_type": _one_of("presented_sender_type", SENDER_TYPES),
        "reviewed_sender_type": _one_of("reviewed_sender_type", SENDER_TYPES, optional=True),
        "system_recommendation": _one_of("system_recommendation", ACTIONS),
        "user_decision": _one_of("user_decision", ACTIONS),
        "status": _one_of("status", MANIFEST_STATUSES),
        "filter_status": _one_of("filter_status", STEP_STATUSES),
        "archive_status": _one_of("archive_status", STEP_STATUSES),
        "log_status": _one_of("log_status", LOG_STEP_STATUSES),
        "state_status": _one_of("state_status", LOG_STEP_STATUSES),
        "sheet_status": _one_of("sheet_status", LOG_STEP_STATUSES),
        "messages_archived": _between("messages_archived", 0),
    }
    broken = violations(manifest, F.col("sender_email"), _known(manifest, rules))
    place = F.concat_ws("|", "run_id", "batch_id", sender_key("sender_email"))
    return broken.unionByName(_repeated(manifest, place, "unique_sender"))


def check_classifications(classifications: DataFrame) -> DataFrame:
    return violations(
        classifications,
        F.col("thread_id"),
        {
            "thread_id": _filled("thread_id"),
            "category": _filled("category"),
            "confidence": _between("confidence", 0, 1),
            "summary": (F.length("summary") <= 500, F.length("summary")),
            "classified_by": _one_of("classified_by", CLASSIFIED_BY),
        },
    )
