"""Label plans for classified threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.joins import spread_join
from mailsift.ranking import chunk
from mailsift.schema import INBOX, TRIAGE_LABEL
from mailsift.session import durable

# Message ids per modify request.
REQUEST_IDS = 1000


def label_targets(classifications: DataFrame, messages: DataFrame, labels: DataFrame) -> DataFrame:
    """Messages to label: (thread_id, category, actionable, label_id, message_id, ingest_seq).

    ``labels`` is (name, label_id) with unique names.
    """
    named = labels.select(F.col("name").alias("category"), "label_id")
    labeled = classifications.select("thread_id", "category", "actionable").join(named, "category")
    return spread_join(messages.select("thread_id", "message_id", "ingest_seq"), labeled, "thread_id", "inner")


def label_failures(classifications: DataFrame, messages: DataFrame, labels: DataFrame) -> DataFrame:
    """Classifications that cannot be applied: (thread_id, category, reason).

    A thread without messages is reported before a category without a label.
    """
    threads = messages.select("thread_id").distinct().withColumn("_known", F.lit(True))
    named = labels.select(F.col("name").alias("category"), F.lit(True).alias("_named"))
    wanted = classifications.select("thread_id", "category")
    reason = F.when(F.col("_known").isNull(), "no messages").when(F.col("_named").isNull(), "no label")
    checked = wanted.join(threads, "thread_id", "left").join(named, "category", "left")
    return checked.select("thread_id", "category", reason.alias("reason")).filter(F.col("reason").isNotNull())


def _texts(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def request_rows(targets: DataFrame, group: list[str], size: int = REQUEST_IDS) -> DataFrame:
    """Gather message ids into requests of at most ``size``: (group, chunk_no, message_ids, ids)."""
    chunked = chunk(durable(targets, "request-ids"), group, "ingest_seq", size)
    ids = F.array_sort(F.collect_list(F.struct("ingest_seq", "message_id")))
    return chunked.groupBy(*group, "chunk_no").agg(
        ids["message_id"].alias("message_ids"), F.count(F.lit(1)).alias("ids")
    )


def label_plan(classifications: DataFrame, messages: DataFrame, labels: DataFrame, size: int = REQUEST_IDS) -> DataFrame:
    """Modify requests: archive removes the inbox label, triage adds the triage label."""
    action = F.when(F.col("actionable"), "triage").otherwise("archive")
    targets = label_targets(classifications, messages, labels).withColumn("action", action)
    plan = request_rows(targets, ["label_id", "action"], size)
    triage_id = labels.filter(F.col("name") == TRIAGE_LABEL).agg(F.max("label_id")).scalar()
    triage_ids = F.array_compact(F.array(F.col("label_id"), F.col("_triage_id")))
    return (
        plan.withColumn("_triage_id", triage_id)
        .withColumn("add_labels", F.when(F.col("action") == "triage", triage_ids).otherwise(F.array("label_id")))
        .withColumn("remove_labels", F.when(F.col("action") == "archive", _texts(INBOX)).otherwise(_texts()))
        .drop("_triage_id")
    )


def apply_summary(plan: DataFrame, failures: DataFrame) -> DataFrame:
    """Messages applied, archived and triaged, and the number of failures: one row."""
    counts = plan.agg(
        F.coalesce(F.sum("ids"), F.lit(0)).alias("applied"),
        F.coalesce(F.sum(F.when(F.col("action") == "archive", F.col("ids"))), F.lit(0)).alias("archived"),
        F.coalesce(F.sum(F.when(F.col("action") == "triage", F.col("ids"))), F.lit(0)).alias("triaged"),
    )
    return counts.withColumn("failures", failures.agg(F.count(F.lit(1))).scalar())


def missing_labels(required: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct required label names that do not exist."""
    return required.select("name").distinct().join(existing.select("name"), "name", "left_anti")
