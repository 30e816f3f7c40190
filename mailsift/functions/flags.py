"""Flag and month columns of the stored message table, and predicates that use them.

Parquet keeps no statistics that help a test on an array of labels. The stored table
therefore carries the two hot label tests as booleans and the month of receipt as its
partition; the predicates below use them where a table has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.schema import INBOX, STARRED

LABEL_FLAGS = {INBOX: "in_inbox", STARRED: "is_starred"}
MONTH = "yyyy-MM"


def with_flags(messages: DataFrame) -> DataFrame:
    """Add in_inbox, is_starred and month."""
    for label, flag in LABEL_FLAGS.items():
        messages = messages.withColumn(flag, F.array_contains("labels", label))
    return messages.withColumn("month", F.date_format("date_received", MONTH))


def has_label(messages: DataFrame, label: str) -> Column:
    """Test for a label: the flag column if the table has it, else the labels."""
    flag = LABEL_FLAGS.get(label)
    return F.col(flag) if flag in messages.columns else F.array_contains("labels", label)


def received_since(messages: DataFrame, since: Column) -> Column:
    """Test for receipt at or after ``since``; months before it are not read at all."""
    recent = F.col("date_received") >= since
    return recent & (F.col("month") >= F.date_format(since, MONTH)) if "month" in messages.columns else recent
