"""Writers: JSON shards, Parquet tables, state and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.flags import with_flags
from mailsift.functions.measure import iso_instant
from mailsift.operators.quality import check_state, check_stats
from mailsift.ranking import chunk
from mailsift.session import durable

SHARD_RECORDS = 500


def message_record() -> Column:
    """A message in the field names of the JSON shards."""
    return F.struct(
        F.col("message_id").alias("messageId"),
        F.col("thread_id").alias("threadId"),
        "sender",
        "recipients",
        "subject",
        iso_instant("date_received").alias("dateReceived"),
        F.col("category").alias("gmailCategory"),
        "labels",
        F.col("is_unread").alias("isUnread"),
        "snippet",
    )


def write_shards(messages: DataFrame, path: str, size: int = SHARD_RECORDS) -> None:
    """JSON arrays of at most ``size`` records, one file in each folder shard=NNNNN.

    An edge format for exchange; tables that Spark reads again belong in Parquet.
    """
    write_numbered(chunk(messages, [], "ingest_seq", size, "shard"), path)


def write_numbered(shards: DataFrame, path: str) -> None:
    """Messages with their ``shard`` from 0, written as one JSON array for each."""
    # Records become text first: one string is cheaper to shuffle and to collect than nested columns.
    records = shards.select("shard", F.struct("ingest_seq", F.to_json(message_record()).alias("record")).alias("r"))
    listed = F.array_join(F.sort_array(F.collect_list("r"))["record"], ",")
    arrays = records.groupBy("shard").agg(F.concat(F.lit("["), listed, F.lit("]")).alias("value"))
    # At least five digits; a longer number keeps all of its own.
    arrays.withColumn("shard", F.format_string("%05d", F.col("shard") + 1)).write.partitionBy("shard").text(path)


def write_messages(messages: DataFrame, path: str) -> None:
    """The message table: Parquet, one folder per month of receipt.

    Rows go to their month through a rebalance, which also splits a month that is large.
    """
    with_flags(messages).hint("rebalance", "month").write.partitionBy("month").parquet(path)


def write_sender_state(state: DataFrame, path: str) -> None:
    """Overwrite the stored sender state, after its rules hold.

    The new state is first written to the scratch folder, so it may derive from the very
    table it replaces and is computed once for the checks and the write.
    """
    staged = durable(state, "state")
    for broken in (check_stats(staged), check_state(staged)):
        first = broken.limit(1).collect()
        if first:
            raise ValueError(f"invalid sender state: {first[0].asDict()}")
    staged.write.mode("overwrite").parquet(path)


def write_lines(lines: DataFrame, order: list[Column | str], path: str) -> None:
    """A report as text files whose order is the order of the lines."""
    lines.orderBy(*order).select("line").write.text(path)


def write_audit(audit: DataFrame, path: str) -> None:
    """The audit table as CSV with a header."""
    audit.write.option("header", True).csv(path)
