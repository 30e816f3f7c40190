"""Decision log: latest decisions, upsert, few-shot examples, dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.functions.address import decision_key, sender_key
from mailsift.ranking import last_wins, latest_wins
from mailsift.schema import NOISE_ACTIONS

LOG_KEY = ["run_id", "batch_id", "sender_key"]


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The latest decision per sender; of equal times, the first in the log."""
    keyed = decisions.withColumn("sender_key", decision_key("sender_email"))
    return latest_wins(keyed, ["sender_key"], "decided_at", "log_seq")


def latest_in_run(log: DataFrame, run_id: str) -> DataFrame:
    """The last log row per sender within one run."""
    run = log.filter(F.col("run_id") == run_id).withColumn("sender_key", sender_key("sender_email"))
    return last_wins(run, ["sender_key"], "log_seq")


def upsert_decisions(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The log with ``entries`` merged in: same (run, batch, sender) is replaced in place.

    ``log_seq`` of entries must continue that of the log; a replaced row keeps the
    position of the row it replaces.
    """
    both = log.unionByName(entries, allowMissingColumns=True)
    keyed = both.withColumn("sender_key", sender_key("sender_email"))
    row = F.struct(*[F.col(c) for c in both.columns if c != "log_seq"])
    merged = keyed.groupBy(*LOG_KEY).agg(
        F.max_by(row, F.col("log_seq")).alias("_row"), F.min("log_seq").alias("log_seq")
    )
    return merged.select("_row.*", "log_seq")


def not_yet_logged(entries: DataFrame, log: DataFrame) -> DataFrame:
    """Entries whose (run, batch, sender) the log does not hold."""
    done = log.select("run_id", "batch_id", sender_key("sender_email").alias("sender_key"))
    keyed = entries.withColumn("sender_key", sender_key("sender_email"))
    return keyed.join(done, LOG_KEY, "left_anti").drop("sender_key")


def with_feedback(decisions: DataFrame) -> DataFrame:
    """Add ``feedback``: corrected, confirmed or none."""
    reviewed = F.col("reviewed_type")
    return decisions.withColumn(
        "feedback",
        F.when(reviewed.isNull(), "none").when(reviewed != F.col("presented_type"), "corrected").otherwise("confirmed"),
    )


def few_shot(decisions: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` examples, corrected before confirmed, each in log order."""
    if n <= 0:
        raise ValueError("n must be greater than 0")
    rank = F.when(F.col("feedback") == "corrected", 0).otherwise(1)
    usable = (F.col("feedback") == "confirmed") | (
        (F.col("feedback") == "corrected") & F.col("reviewed_type").isNotNull()
    )
    kind = F.when(F.col("feedback") == "corrected", F.col("reviewed_type")).otherwise(F.col("presented_type"))
    return (
        decisions.filter(usable)
        .orderBy(rank, "log_seq")
        .limit(n)
        .select("sender_email", kind.alias("sender_type"), F.col("feedback").alias("context"), "log_seq")
    )


def noise_senders(decisions: DataFrame) -> DataFrame:
    """Senders whose latest decision is filter or unsubscribe: (sender_key, action)."""
    latest = latest_decisions(decisions)
    return latest.filter(F.col("user_decision").isin(NOISE_ACTIONS)).select(
        "sender_key", F.col("user_decision").alias("action")
    )


def order_noise(noise: DataFrame) -> DataFrame:
    """The filter list, then the unsubscribe list, each sorted."""
    return noise.orderBy(F.when(F.col("action") == "filter", 0).otherwise(1), "sender_key")


def run_dashboard(log: DataFrame, run_id: str, senders: DataFrame) -> DataFrame:
    """Progress of one run over all ``senders``: one row."""
    latest = latest_in_run(log, run_id)
    counts = latest.agg(
        F.count(F.lit(1)).alias("processed"),
        F.coalesce(F.sum("messages_archived"), F.lit(0)).alias("emails_cleared"),
        F.count_if(F.col("user_decision") == "unsubscribe").alias("unsubscribed"),
        F.count_if(F.array_contains("actions_taken", "filter")).alias("senders_filtered"),
    )
    total = senders.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("total_senders", total).withColumn(
        "remaining", F.greatest(F.col("total_senders") - F.col("processed"), F.lit(0))
    )
