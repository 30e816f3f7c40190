"""Plans that take noise out of the inbox: sweep, retroactive archive, per-sender filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.address import sender_key
from mailsift.functions.flags import has_label, received_since
from mailsift.joins import spread_join
from mailsift.operators.decisions import noise_senders
from mailsift.operators.labels import REQUEST_IDS, request_rows
from mailsift.operators.packing import pack_or_queries
from mailsift.ranking import number_by_sequence
from mailsift.schema import INBOX, NOISE_LABEL, UNREAD
from mailsift.session import durable

# Labels outside the mailbox scope.
OUT_OF_SCOPE = ["SPAM", "TRASH", "DRAFT", "SENT"]
# Senders per sweep query and the text around it.
SWEEP_SENDERS = 25
SWEEP_WRAP = ("in:inbox (", ")")


def _labels(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def in_scope(messages: DataFrame) -> DataFrame:
    """All mail except spam, trash, drafts and sent."""
    return messages.filter(~F.arrays_overlap("labels", _labels(*OUT_OF_SCOPE)))


def new_since(messages: DataFrame, since: Column) -> DataFrame:
    return in_scope(messages).filter(received_since(messages, since))


def messages_from(messages: DataFrame, sender: str) -> DataFrame:
    return messages.filter(sender_key("sender.email") == sender.lower())


def inbox_from(messages: DataFrame, senders: DataFrame) -> DataFrame:
    """Inbox messages of the given senders (column sender_key)."""
    inbox = messages.filter(has_label(messages, INBOX))
    keyed = inbox.withColumn("sender_key", sender_key("sender.email"))
    return spread_join(keyed, senders.select("sender_key").distinct(), "sender_key", "left_semi")


def noise_in_inbox(messages: DataFrame, noise: DataFrame) -> DataFrame:
    return inbox_from(messages, noise)


def extraction_messages(messages: DataFrame, state: DataFrame) -> DataFrame:
    """Messages of senders worth extracting content from."""
    wanted = state.filter(F.col("extraction_candidate")).select(sender_key("sender_email").alias("sender_key"))
    keyed = messages.withColumn("sender_key", sender_key("sender.email"))
    return spread_join(keyed, wanted.distinct(), "sender_key", "left_semi")


def add_noise_category(messages: DataFrame, label: str = NOISE_LABEL) -> DataFrame:
    """Add ``merged_labels``: the message's labels as a set, with the noise label."""
    return messages.withColumn("merged_labels", F.array_union("labels", _labels(label)))


def sweep_plan(messages: DataFrame, decisions: DataFrame, size: int = REQUEST_IDS) -> DataFrame:
    """Modify requests over the inbox messages of noise senders.

    What is swept is written down before it is numbered, so messages and decisions are
    read once.
    """
    found = noise_in_inbox(messages, noise_senders(decisions)).select("message_id", "ingest_seq")
    plan = request_rows(found, [], size)
    return plan.withColumn("add_labels", _labels(NOISE_LABEL)).withColumn("remove_labels", _labels(INBOX))


def sweep_queries(noise: DataFrame) -> DataFrame:
    """The search texts of a sweep, for mailboxes that are searched remotely."""
    rank = F.when(F.col("action") == "filter", 0).otherwise(1)
    listed = noise.select(rank.alias("_rank"), F.col("sender_key").alias("sender"))
    return pack_or_queries(listed, order=["_rank", "sender"], max_items=SWEEP_SENDERS, wrap=SWEEP_WRAP)


def sweep_summary(plan: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries, messages found and messages swept: one row."""
    found = F.coalesce(F.sum("ids"), F.lit(0))
    counts = plan.agg(found.alias("messages_found"), found.alias("messages_swept"))
    return counts.withColumn("queries", queries.agg(F.count(F.lit(1))).scalar())


def cap_per_sender(
    messages: DataFrame, senders: DataFrame, max_messages: int | None = None, max_senders: int | None = None
) -> DataFrame:
    """Messages of ``senders`` under caps on messages per sender and on senders.

    ``truncated`` tells that a sender has more messages than its cap. Positions come from
    bucketed numbering, so a sender with most of the mail is no single task.
    """
    for cap in (max_messages, max_senders):
        if cap is not None and cap <= 0:
            raise ValueError("caps must be positive")
    active = senders.select("sender_key").distinct()
    if max_senders is not None:
        active = active.orderBy("sender_key").limit(max_senders)
    active = durable(active, "active-senders")
    keyed = messages.withColumn("sender_key", sender_key("sender.email"))
    own = spread_join(keyed, active, "sender_key", "left_semi").select("sender_key", "message_id", "ingest_seq")
    if max_messages is None:
        return own.withColumn("truncated", F.lit(False))
    totals = own.groupBy("sender_key").agg((F.count(F.lit(1)) > max_messages).alias("truncated"))
    ranked = number_by_sequence(own, ["sender_key"], "ingest_seq", "_rn").filter(F.col("_rn") <= max_messages)
    return ranked.drop("_rn").join(totals, "sender_key")


def archive_plan(
    messages: DataFrame,
    senders: DataFrame,
    max_messages: int | None = None,
    max_senders: int | None = None,
    size: int = REQUEST_IDS,
) -> DataFrame:
    """Modify requests per sender that archive all of the sender's mail, under caps."""
    capped = cap_per_sender(messages, senders, max_messages, max_senders)
    plan = request_rows(capped, ["sender_key", "truncated"], size)
    return plan.withColumn("add_labels", _labels(NOISE_LABEL)).withColumn("remove_labels", _labels(INBOX))


def remove_labels_for(action: Column) -> Column:
    """Labels that a noise filter removes, sorted; unsubscribe also marks as read."""
    return F.when(action == "unsubscribe", _labels(INBOX, UNREAD)).otherwise(_labels(INBOX))


def filter_plan(decisions: DataFrame) -> DataFrame:
    """One mailbox filter per noise sender."""
    return noise_senders(decisions).select(
        F.col("sender_key").alias("from_addr"),
        "action",
        _labels(NOISE_LABEL).alias("add_labels"),
        remove_labels_for(F.col("action")).alias("remove_labels"),
    )


def covered_by_rule(rules: DataFrame, senders: DataFrame, archive_folder: str) -> DataFrame:
    """Senders that an existing mailbox rule already archives as noise.

    ``rules`` has is_enabled, sender_contains (array), move_to_folder, assign_categories
    (array) and other_conditions: map<string, string> of all further conditions as JSON
    text. A rule counts only when no further condition is active.
    """
    others = F.coalesce(F.map_values("other_conditions"), F.array().cast("array<string>"))
    flat = rules.withColumn("_active", F.exists(others, lambda v: ~_idle(v)))
    usable = flat.filter(
        F.coalesce("is_enabled", F.lit(False))
        & (F.col("move_to_folder") == archive_folder)
        & F.coalesce(F.array_contains("assign_categories", NOISE_LABEL), F.lit(False))
        & ~F.col("_active")
    )
    listed = usable.select(F.explode("sender_contains").alias("_text")).select(
        F.lower("_text").alias("sender_key")
    ).distinct()
    return senders.withColumn("sender_key", sender_key("sender_email")).join(listed, "sender_key", "left_semi")


def _idle(value: Column) -> Column:
    """True for a condition value that has no effect: missing, false, or an empty list or text."""
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return text.isin("", "null", "false", "[]") | text.rlike(r'^"\s*"$')
