"""Batch manifests, audit table, triage queue and review decisions.

A manifest is one row per (run, batch, sender) with a ``position`` inside the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.address import sender_key, trim_all
from mailsift.functions.measure import at, iso_instant, whole_percent, ymd
from mailsift.joins import spread_join
from mailsift.operators.decisions import not_yet_logged
from mailsift.operators.labels import REQUEST_IDS, request_rows
from mailsift.operators.state import OPTIONAL_FIELDS, REVIEW_FIELDS, with_optional
from mailsift.ranking import last_wins
from mailsift.schema import ACTIONS, INBOX, STARRED, TRIAGE_LABEL
from mailsift.session import durable

STEPS = ["filter_status", "archive_status", "log_status", "state_status", "sheet_status"]
BATCH = ["run_id", "batch_id"]

# The audit table's columns, in order.
AUDIT_COLUMNS = [
    "Sender email",
    "Sender name",
    "Email count",
    "First email date",
    "Last email date",
    "Gmail category",
    "Unread ratio",
    "Thread count",
    "Sample subjects",
    "Confidence tier",
    "Recommended action",
    "Surprises flag",
    "Your decision",
    "Sender type",
    "Extraction candidate",
    "Processed",
]


def initial_manifest(senders: DataFrame) -> DataFrame:
    """A prepared manifest: every step pending, nothing archived."""
    manifest = senders.withColumn("status", F.lit("prepared")).withColumn("filter_applied", F.lit(False))
    for step in STEPS:
        manifest = manifest.withColumn(step, F.lit("pending"))
    return manifest.withColumn("messages_archived", F.lit(0).cast("bigint"))


def batch_summary(manifest: DataFrame) -> DataFrame:
    """Senders, mail and mean unread ratio per batch."""
    return manifest.groupBy(*BATCH).agg(
        F.count(F.lit(1)).alias("sender_count"),
        F.coalesce(F.sum("email_count"), F.lit(0)).alias("total_email_count"),
        F.coalesce(F.avg("unread_ratio"), F.lit(0.0)).alias("average_unread_ratio"),
    )


def pending_steps(manifest: DataFrame, skip_filters: bool = True) -> DataFrame:
    """One row per pending step with the status it will get: done or skipped.

    Keep skips filter and archive; filters are skipped for all senders by default.
    """
    keep = F.col("user_decision") == "keep"
    steps = []
    for number, step in enumerate(STEPS):
        skipped = F.lit(False)
        if step == "filter_status":
            skipped = F.lit(True) if skip_filters else keep
        elif step == "archive_status":
            skipped = keep
        outcome = F.when(skipped, "skipped").otherwise("done")
        steps.append(
            F.when(
                F.col(step) == "pending",
                F.struct(F.lit(number).alias("step_no"), F.lit(step).alias("step"), outcome.alias("outcome")),
            )
        )
    rows = manifest.select(*BATCH, "sender_email", F.explode(F.array_compact(F.array(*steps))).alias("_s"))
    return rows.select(*BATCH, "sender_email", "_s.step_no", "_s.step", "_s.outcome")


def decision_entries(manifest: DataFrame, log: DataFrame, now) -> DataFrame:
    """Log entries of a manifest that the log does not hold yet."""
    reviewed, presented = F.col("reviewed_sender_type"), F.col("presented_sender_type")
    feedback = F.when(reviewed.isNull(), "none").when(reviewed != presented, "corrected").otherwise("confirmed")
    taken = F.array_compact(
        F.array(
            F.when(F.coalesce("filter_applied", F.lit(False)), "filter"),
            F.when(F.col("messages_archived") > 0, "archive"),
        )
    )
    keep = F.col("user_decision") == "keep"
    entries = manifest.select(
        *BATCH,
        "sender_email",
        "sender_name",
        presented.alias("presented_type"),
        reviewed.alias("reviewed_type"),
        feedback.alias("feedback"),
        "system_recommendation",
        "user_decision",
        at(now).alias("decided_at"),
        "email_count",
        "messages_archived",
        F.when(keep, F.array().cast("array<string>")).otherwise(taken).alias("actions_taken"),
    )
    return not_yet_logged(entries, log)


def batch_dashboard(manifest: DataFrame) -> DataFrame:
    """Progress per batch, from the manifest alone."""
    return manifest.groupBy(*BATCH).agg(
        F.count(F.lit(1)).alias("total_senders"),
        F.count_if(F.col("sheet_status") == "done").alias("processed"),
        F.sum("messages_archived").alias("emails_cleared"),
        F.count_if(F.col("user_decision") == "unsubscribe").alias("unsubscribed"),
        F.count_if("filter_applied").alias("filters_created"),
        F.count_if(F.col("sheet_status") != "done").alias("remaining"),
    )


def validate_manifest(manifest: DataFrame, state: DataFrame, audit: DataFrame) -> DataFrame:
    """Manifest senders without a state entry or an audit row: (sender_email, reason)."""
    wanted = manifest.select("sender_email", sender_key("sender_email").alias("_key"))

    def missing(table: DataFrame, reason: str) -> DataFrame:
        known = table.select(sender_key("sender_email").alias("_key"))
        return wanted.join(known, "_key", "left_anti").select("sender_email", F.lit(reason).alias("reason"))

    return missing(state, "state").unionByName(missing(audit, "audit"))


def audit_rows(state: DataFrame, dialect: str = "gmail") -> DataFrame:
    """The audit table: 16 columns with display formats (snake_case names)."""
    state = with_optional(state, REVIEW_FIELDS | OPTIONAL_FIELDS | {"surprises_flag": "boolean"})
    ratio = F.concat(whole_percent("unread_ratio").cast("string"), F.lit("%"))
    if dialect == "o365":
        ratio = F.col("unread_ratio")

    def blank(name: str) -> Column:
        return F.coalesce(name, F.lit("")).alias(name)

    extract = F.when(F.col("extraction_candidate"), "Yes").when(~F.col("extraction_candidate"), "No").otherwise("")
    surprise = F.when(F.col("surprises_flag"), "Yes").otherwise("No")
    return state.select(
        "sender_email",
        "sender_name",
        "email_count",
        iso_instant("first_email_date").alias("first_email_date"),
        iso_instant("last_email_date").alias("last_email_date"),
        "category",
        ratio.alias("unread_ratio"),
        "thread_count",
        F.array_join("sample_subjects", " | ").alias("sample_subjects"),
        blank("confidence_tier"),
        blank("recommended_action"),
        surprise.alias("surprises_flag"),
        blank("user_decision"),
        blank("sender_type"),
        extract.alias("extraction_candidate"),
        F.lit("").alias("processed"),
    )


def audit_sheet(audit: DataFrame) -> DataFrame:
    """Audit rows under their display column names."""
    return audit.toDF(*AUDIT_COLUMNS)


def read_audit_decisions(audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions a reviewer wrote into the audit table, and the invalid ones.

    Needs sender_email, user_decision and row_no. Blank decisions and senders are
    ignored, the last row of a sender wins, and the sender key is trimmed only.
    """
    decision = F.lower(trim_all(F.coalesce("user_decision", F.lit(""))))
    rows = audit.select(
        trim_all(F.coalesce("sender_email", F.lit(""))).alias("sender_email"),
        F.col("user_decision").alias("raw_decision"),
        decision.alias("decision"),
        "row_no",
    ).filter(F.col("decision") != "")
    valid = F.col("decision").isin(ACTIONS)
    decided = last_wins(rows.filter(valid & (F.col("sender_email") != "")), ["sender_email"], "row_no")
    return decided.select("sender_email", "decision"), rows.filter(~valid).select("sender_email", "raw_decision")


def update_audit(audit: DataFrame, manifest: DataFrame, now) -> DataFrame:
    """Audit rows after a batch: decision, type and processed date of its senders."""
    done = manifest.select(
        sender_key("sender_email").alias("_key"),
        F.col("user_decision").alias("_decision"),
        F.coalesce("reviewed_sender_type", "presented_sender_type").alias("_type"),
        ymd(at(now)).alias("_processed"),
    )
    joined = audit.withColumn("_key", sender_key("sender_email")).join(done, "_key", "left")
    changed = {
        "user_decision": F.coalesce("_decision", "user_decision"),
        "sender_type": F.coalesce("_type", "sender_type"),
        "processed": F.coalesce("_processed", "processed"),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in audit.columns])


def triage_queue(messages: DataFrame, label: str = TRIAGE_LABEL) -> DataFrame:
    return messages.filter(F.array_contains("labels", label))


def triage_threads(triage: DataFrame) -> DataFrame:
    """Per thread the first listed message and the message count."""
    return triage.groupBy("thread_id").agg(
        F.min_by("message_id", "ingest_seq").alias("representative_id"),
        F.count(F.lit(1)).alias("message_count"),
    )


def triage_items(triage: DataFrame, labels: DataFrame) -> DataFrame:
    """One report item per thread, taken from its first listed message.

    The category is the first label, by name, that is no ``_`` label and no all-capitals
    system label; ``labels`` is (label_id, name), and an unknown id counts as its own name.
    """
    first = F.min_by(
        F.struct("message_id", F.col("sender.email").alias("email"), "subject", "date_received", "labels"),
        F.col("ingest_seq"),
    )
    heads = triage.groupBy("thread_id").agg(first.alias("_m"), F.count(F.lit(1)).alias("message_count"))
    tagged = heads.select("thread_id", F.posexplode("_m.labels").alias("_pos", "label_id"))
    named = tagged.join(labels.select("label_id", "name"), "label_id", "left").withColumn(
        "name", F.coalesce("name", "label_id")
    )
    usable = named.filter(~F.col("name").startswith("_") & ~F.col("name").rlike(r"^[A-Z_]+\z"))
    categories = usable.groupBy("thread_id").agg(F.min_by("name", "_pos").alias("category"))
    return heads.join(categories, "thread_id", "left").select(
        "thread_id",
        F.col("_m.message_id").alias("representative_id"),
        "message_count",
        F.col("_m.email").alias("sender_email"),
        F.col("_m.subject").alias("subject"),
        F.col("_m.date_received").alias("date_received"),
        F.coalesce("category", F.lit("uncategorized")).alias("category"),
    )


def collated(name: str) -> Column:
    """Column in locale order, where ``a`` comes before ``B``."""
    return F.collate(F.col(name), "UNICODE")


def order_action_items(items: DataFrame) -> DataFrame:
    return items.orderBy(*[collated(c) for c in ("category", "sender_email", "subject", "thread_id")])


def resolve_decisions(decisions: DataFrame, triage: DataFrame) -> DataFrame:
    """Review decisions (review_id, decision) resolved to triage threads, with an outcome.

    A review id may be a thread id or a message id. Outcomes: ok; unknown (neither);
    ambiguous (both, of different threads); conflicting (two decisions for one thread).
    """
    threads = triage.select(F.col("thread_id").alias("review_id")).distinct().withColumn("_by_thread", F.col("review_id"))
    members = triage.groupBy(F.col("message_id").alias("review_id")).agg(F.max("thread_id").alias("_by_message"))
    found = decisions.join(threads, "review_id", "left").join(members, "review_id", "left")
    ambiguous = (F.col("_by_thread") != F.col("_by_message")) & F.col("_by_message").isNotNull()
    resolved = found.withColumn("_ambiguous", F.coalesce(ambiguous, F.lit(False))).withColumn(
        "thread_id", F.when(~F.col("_ambiguous"), F.coalesce("_by_thread", "_by_message"))
    )
    mixed = (
        resolved.filter(F.col("thread_id").isNotNull())
        .groupBy("thread_id")
        .agg((F.min("decision") != F.max("decision")).alias("_mixed"))
    )
    outcome = (
        F.when(F.col("_ambiguous"), "ambiguous")
        .when(F.col("thread_id").isNull(), "unknown")
        .when(F.col("_mixed"), "conflicting")
        .otherwise("ok")
    )
    return resolved.join(mixed, "thread_id", "left").select("review_id", "decision", "thread_id", outcome.alias("outcome"))


def review_counts(resolved: DataFrame) -> DataFrame:
    """Threads to star and to archive: one row."""
    threads = resolved.select("thread_id", "decision").distinct()
    return threads.agg(
        F.count_if(F.col("decision") == "star").alias("starred"),
        F.count_if(F.col("decision") == "archive").alias("archived"),
    )


def finalize_plan(decisions: DataFrame, triage: DataFrame, size: int = REQUEST_IDS) -> DataFrame:
    """Modify requests of a review. Any decision that is not ok rejects the whole review."""
    resolved = durable(resolve_decisions(decisions, triage), "resolved")
    rejected = resolved.filter(F.col("outcome") != "ok").limit(1).collect()
    if rejected:
        raise ValueError(f"review rejected: {rejected[0]['review_id']} is {rejected[0]['outcome']}")
    threads = resolved.select("thread_id", "decision").distinct()
    targets = spread_join(triage.select("thread_id", "message_id", "ingest_seq"), threads, "thread_id", "inner")
    plan = request_rows(targets, ["decision"], size)
    star = F.col("decision") == "star"
    none = F.array().cast("array<string>")
    return plan.withColumn("add_labels", F.when(star, F.array(F.lit(STARRED))).otherwise(none)).withColumn(
        "remove_labels",
        F.when(star, F.array(F.lit(TRIAGE_LABEL))).otherwise(F.array(F.lit(INBOX), F.lit(TRIAGE_LABEL))),
    )
