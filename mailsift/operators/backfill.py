"""Pull errors and the recovery of messages that failed.

Errors are (error_seq, message, kind, message_id); staged rows are messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.text import LEGACY_MESSAGE_ID, legacy_message_id
from mailsift.ranking import last_wins

SHARD_RECORDS = 500
# Leading hexadecimal digits that name the bucket of an id in a fingerprint.
BUCKET_DIGITS = 4


def _has_id() -> Column:
    return F.coalesce(F.col("message_id") != "", F.lit(False))


def error_level(errors: DataFrame) -> DataFrame:
    """Add level: the stated kind, else message if an id is known or named in the text, else system."""
    named = _has_id() | F.col("message").rlike(LEGACY_MESSAGE_ID)
    level = F.when(F.col("kind").isin("message", "system"), F.col("kind")).when(named, "message").otherwise("system")
    return errors.withColumn("level", level)


def recovery_ids(errors: DataFrame) -> DataFrame:
    """Distinct ids of failed messages."""
    found = F.when(_has_id(), F.col("message_id")).otherwise(legacy_message_id("message"))
    return errors.select(found.alias("message_id")).filter(F.col("message_id").isNotNull()).distinct()


def fingerprint(ids: DataFrame) -> DataFrame:
    """One digest of a set of ids, of any size: (ids, fingerprint).

    Ids fall into FINGERPRINT_BUCKETS by the first digits of their SHA-256. A bucket's
    digest is that of the sorted id digests in it, and the fingerprint is the digest of
    the bucket digests in order. Equal sets have equal fingerprints. No task holds more
    than one bucket; a bucket of a set of 10^9 ids holds 15,000.
    """
    digits = F.sha2("message_id", 256)
    hashed = ids.select("message_id").distinct().select(digits.alias("_h"))
    buckets = hashed.groupBy(F.substring("_h", 1, BUCKET_DIGITS).alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), "\n"), 256).alias("_d")
    )
    entries = F.array_sort(F.collect_list(F.struct("_b", "_d")))
    return buckets.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("ids"),
        F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(e["_b"], F.lit(":"), e["_d"])), "\n"), 256).alias("fingerprint"),
    )


def residual_errors(residuals: DataFrame, targets: DataFrame, recovered: DataFrame) -> DataFrame:
    """The last residual error of each target that was not recovered."""
    open_targets = targets.select("message_id").distinct().join(recovered.select("message_id"), "message_id", "left_anti")
    return last_wins(residuals.join(open_targets, "message_id", "left_semi"), ["message_id"], "error_seq")


def new_errors(errors: DataFrame, recovered: DataFrame) -> DataFrame:
    """System errors, and message errors whose message was not recovered."""
    leveled = error_level(errors).withColumn("_id", F.coalesce("message_id", legacy_message_id("message")))
    system = leveled.filter(F.col("level") == "system")
    done = recovered.select(F.col("message_id").alias("_id")).distinct()
    unrecovered = leveled.filter(F.col("level") == "message").join(done, "_id", "left_anti")
    return system.unionByName(unrecovered).drop("_id")


def recovered_rows(staged: DataFrame) -> DataFrame:
    """Staged messages, the last row per id."""
    return last_wins(staged, ["message_id"], "ingest_seq")


def backfill_report(targets: DataFrame, recovered: DataFrame, residuals: DataFrame) -> DataFrame:
    """Targets, recovered, still failing and shards: one row."""
    done = recovered.select("message_id").agg(F.count_distinct("message_id").alias("recovered"))
    totals = done.withColumn("targets", targets.select("message_id").agg(F.count_distinct("message_id")).scalar())
    return totals.withColumn("still_failing", residuals.agg(F.count(F.lit(1))).scalar()).withColumn(
        "shards", F.ceil(F.col("recovered") / F.lit(SHARD_RECORDS)).cast("bigint")
    )


def pull_statistics(messages: DataFrame, errors: DataFrame) -> DataFrame:
    """Messages fetched and errors per level: (measure, n)."""
    fetched = messages.agg(F.count(F.lit(1)).alias("n")).select(F.lit("fetched").alias("measure"), "n")
    levels = error_level(errors).groupBy(F.concat(F.lit("errors_"), "level").alias("measure"))
    return fetched.unionByName(levels.agg(F.count(F.lit(1)).alias("n")))


def pending_bodies(ids: DataFrame, done: DataFrame, cache: DataFrame) -> DataFrame:
    """Ids whose body is not both marked as done and in the cache."""
    ready = done.select("message_id").join(cache.select("message_id"), "message_id", "left_semi")
    return ids.select("message_id").join(ready, "message_id", "left_anti")
