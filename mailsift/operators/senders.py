"""Per-sender statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.functions.address import local_part, sender_key
from mailsift.functions.flags import has_label
from mailsift.functions.measure import arrival_order
from mailsift.ranking import number_by_order
from mailsift.schema import IMPORTANT, SENDER_TYPES, STARRED

# Local parts of notification senders.
NOTIFICATION_LOCAL_PARTS = ["noreply", "no-reply", "notifications"]
# Order in which sender types come up for review.
REVIEW_ORDER = ["newsletter", "automated", "company", "human", "unknown"]


def _keyed(messages: DataFrame) -> DataFrame:
    return messages.withColumn("sender_email", sender_key("sender.email"))


def _profiles(messages: DataFrame) -> DataFrame:
    """Counts per (sender, category, display name).

    The group holds the few-valued text columns, so all buffers are fixed width and
    map-side hash aggregation shrinks a hot sender to a handful of rows per task.
    """
    return (
        _keyed(messages)
        .groupBy("sender_email", "category", F.col("sender.name").alias("sender_name"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("is_unread").alias("n_unread"),
            F.count_if(has_label(messages, STARRED)).alias("n_starred"),
            F.count_if(F.array_contains("labels", IMPORTANT)).alias("n_important"),
            F.min("date_received").alias("first_date"),
            F.max("date_received").alias("last_date"),
            F.max(arrival_order("date_received", "ingest_seq")).alias("last_arrival"),
            F.min("ingest_seq").alias("first_seq"),
        )
    )


def category_counts_per_sender(messages: DataFrame) -> DataFrame:
    """Messages and first appearance per (sender, category)."""
    return (
        _keyed(messages)
        .groupBy("sender_email", "category")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ingest_seq").alias("first_seq"))
    )


def top_category(counts: DataFrame) -> DataFrame:
    """The most frequent category per sender; of equals, the one seen first."""
    return counts.groupBy("sender_email").agg(
        F.max_by("category", F.struct("n", -F.col("first_seq"))).alias("category")
    )


def modal_category(messages: DataFrame) -> DataFrame:
    return top_category(category_counts_per_sender(messages))


def display_name(messages: DataFrame) -> DataFrame:
    """The latest non-empty display name per sender, else an empty string."""
    names = (
        _keyed(messages)
        .groupBy("sender_email", F.col("sender.name").alias("sender_name"))
        .agg(F.max(arrival_order("date_received", "ingest_seq")).alias("last_arrival"))
    )
    return names.groupBy("sender_email").agg(_latest_name().alias("sender_name"))


def _latest_name():
    named = F.col("sender_name") != ""
    return F.coalesce(
        F.max_by(F.when(named, F.col("sender_name")), F.when(named, F.col("last_arrival"))), F.lit("")
    )


def thread_counts(messages: DataFrame) -> DataFrame:
    """Exact distinct threads per sender, first reduced per (sender, thread)."""
    pairs = _keyed(messages).groupBy("sender_email", "thread_id").agg(F.lit(1).alias("_one"))
    return pairs.groupBy("sender_email").agg(F.count("thread_id").alias("thread_count"))


def sample_subjects(messages: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most recent distinct subjects per sender; of equals, the one seen first.

    Reduced per (sender, subject) first; the rank filter is then applied before the
    shuffle as well (window group limit), so a hot sender sends ``n`` rows per task.
    """
    subjects = (
        _keyed(messages)
        .groupBy("sender_email", "subject")
        .agg(F.max("date_received").alias("last_date"), F.min("ingest_seq").alias("first_seq"))
    )
    recent = Window.partitionBy("sender_email").orderBy(F.desc("last_date"), "first_seq")
    top = subjects.withColumn("rn", F.row_number().over(recent)).filter(F.col("rn") <= n)
    listed = F.array_sort(F.collect_list(F.struct("rn", "subject")))
    return top.groupBy("sender_email").agg(listed["subject"].alias("sample_subjects"))


def sender_stats(messages: DataFrame) -> DataFrame:
    """One row per sender.

    Three aggregates on the same key (profile, threads, subjects), each read from a
    pruned scan and each leaving its rows hash-partitioned by sender, so the two joins
    add no shuffle.
    """
    per_category = (
        _profiles(messages)
        .groupBy("sender_email", "category")
        .agg(
            _latest_name().alias("sender_name"),
            F.max(F.when(F.col("sender_name") != "", F.col("last_arrival"))).alias("last_arrival"),
            F.sum("n").alias("n"),
            F.sum("n_unread").alias("n_unread"),
            F.sum("n_starred").alias("n_starred"),
            F.sum("n_important").alias("n_important"),
            F.min("first_date").alias("first_date"),
            F.max("last_date").alias("last_date"),
            F.min("first_seq").alias("first_seq"),
        )
    )
    base = per_category.groupBy("sender_email").agg(
        _latest_name().alias("sender_name"),
        F.sum("n").alias("email_count"),
        F.min("first_date").alias("first_email_date"),
        F.max("last_date").alias("last_email_date"),
        F.max_by("category", F.struct("n", -F.col("first_seq"))).alias("category"),
        (F.sum("n_unread") / F.sum("n")).alias("unread_ratio"),
        F.sum("n_starred").alias("starred_count"),
        F.sum("n_important").alias("important_count"),
        F.min("first_seq").alias("first_seq"),
    )
    return base.join(thread_counts(messages), "sender_email").join(sample_subjects(messages), "sender_email")


def order_by_volume(stats: DataFrame) -> DataFrame:
    """Most mail first; of equals, the sender seen first."""
    return stats.orderBy(F.desc("email_count"), "first_seq")


def leaderboard(stats: DataFrame, n: int) -> DataFrame:
    """The ``n`` senders with most mail, ranked; equal volume shares a rank."""
    top = order_by_volume(stats).limit(n)
    return top.withColumn("rank", F.rank().over(Window.orderBy(F.desc("email_count"))))


def notification_senders(stats: DataFrame) -> DataFrame:
    """Senders and mail of notification addresses, and of all others."""
    kind = F.when(local_part("sender_email").isin(NOTIFICATION_LOCAL_PARTS), "notification").otherwise("other")
    return stats.groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("senders"), F.sum("email_count").alias("emails")
    )


def category_breakdown(messages: DataFrame) -> DataFrame:
    return messages.groupBy("category").agg(F.count(F.lit(1)).alias("emails"))


def monthly_volume(messages: DataFrame) -> DataFrame:
    month = F.date_format("date_received", "yyyy-MM")
    return messages.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("emails"))


def review_batches(state: DataFrame, size: int = 50) -> DataFrame:
    """Review batches per sender type, most mail first, ``size`` senders each.

    ``type_order`` is the order in which the types are reviewed. A type can hold most
    senders, so positions come from a range sort and not from one window per type.
    """
    typed = state.withColumn("sender_type", F.coalesce("sender_type", F.lit("unknown")))
    ranked = number_by_order(typed, ["sender_type"], [F.desc("email_count"), F.col("sender_email")], "position")
    order = F.array_position(F.array(*[F.lit(t) for t in REVIEW_ORDER]), F.col("sender_type"))
    return ranked.withColumn("type_order", order).withColumn("batch_no", F.expr(f"(position - 1) div {size} + 1"))


def type_breakdown(state: DataFrame) -> DataFrame:
    """Senders per type; all five types are listed, a missing type counts as unknown."""
    kind = F.coalesce("sender_type", F.lit("unknown"))
    counts = state.groupBy(kind.alias("sender_type")).agg(F.count(F.lit(1)).alias("n"))
    types = state.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(t) for t in SENDER_TYPES])).alias("sender_type")
    )
    return types.join(counts, "sender_type", "left").select(
        "sender_type", F.coalesce("n", F.lit(0)).alias("senders")
    )


def combine_mailboxes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two mailboxes' sender states as one row per sender."""
    a, b = first.alias("a"), second.alias("b")
    zero = F.lit(0)
    total = F.coalesce("a.email_count", zero) + F.coalesce("b.email_count", zero)
    return a.join(b, F.col("a.sender_email") == F.col("b.sender_email"), "full").select(
        F.coalesce("a.sender_email", "b.sender_email").alias("sender_email"),
        total.alias("email_count"),
        (F.coalesce("a.thread_count", zero) + F.coalesce("b.thread_count", zero)).alias("thread_count"),
        F.least("a.first_email_date", "b.first_email_date").alias("first_email_date"),
        F.greatest("a.last_email_date", "b.last_email_date").alias("last_email_date"),
        F.col("a.sender_email").isNotNull().alias("in_first"),
        F.col("b.sender_email").isNotNull().alias("in_second"),
    )
