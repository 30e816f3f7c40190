"""The recurring incremental jobs as Structured Streaming queries.

Each job takes a source folder of message Parquet files and a checkpoint folder. By
default it processes what is there and stops, so a scheduler may start it at will; pass
``every`` to keep it running.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from mailsift.functions.address import sender_key
from mailsift.functions.flags import has_label, with_flags
from mailsift.operators.noise import in_scope, sweep_plan
from mailsift.operators.normalize import parse_gmail, parse_graph, split
from mailsift.ranking import first_wins, running_total
from mailsift.schema import INBOX, MESSAGE, RAW_GMAIL, RAW_GRAPH, STARRED
from mailsift.session import durable, scratch_run
from mailsift.streaming.runs import FAN, RunTable


# Bits of ingest_seq for the place in a micro-batch.
BATCH_BITS = 40


def message_stream(spark: SparkSession, src: str, schema: T.StructType = MESSAGE) -> DataFrame:
    return spark.readStream.schema(schema).parquet(src)


def _start(writer, every: str | None) -> StreamingQuery:
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def ingest_stream(
    spark: SparkSession, src: str, dst: str, ckpt: str, schema: T.StructType = MESSAGE, every: str | None = None
) -> StreamingQuery:
    """Copy new message files into the message table; a restart continues where it stopped.

    The table gets its flag columns and one folder per month here, where each row is
    touched once anyway.
    """
    flagged = with_flags(message_stream(spark, src, schema))
    writer = flagged.writeStream.format("parquet").option("checkpointLocation", ckpt).partitionBy("month")
    return _start(writer.option("path", dst).outputMode("append"), every)


def pull_stream(
    spark: SparkSession,
    src: str,
    dst: str,
    rejects: str,
    ckpt: str,
    inbox_id: str | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Raw messages, one JSON object per line, into the message table and the table of rejects.

    Without ``inbox_id`` the lines are Gmail-shaped, else Graph-shaped, with that folder as the
    inbox. A micro-batch is parsed once, written down, and split into its own folders of both
    tables, so a batch that is run again replaces what it wrote and a restart equals one run.
    ``ingest_seq`` is the batch, then the place by file and line in it. A line that is no JSON
    is rejected.
    """
    schema = RAW_GMAIL if inbox_id is None else RAW_GRAPH

    def save(batch: DataFrame, batch_id: int) -> None:
        with scratch_run(batch.sparkSession):
            # Only the counts of the splits are put in order; the lines stay where they were read.
            lines = durable(batch.withColumn("line", F.monotonically_increasing_id()), "lines")
            splits = lines.groupBy("file", "block").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("n"))
            placed = lines.join(running_total(splits, ["file", "block"], "n", "before"), ["file", "block"])
            place = F.col("before") + F.col("line") - F.col("first")
            seq = (F.lit(batch_id).cast("long") * (1 << BATCH_BITS) + place).alias("ingest_seq")
            raw = placed.select(F.from_json("value", schema).alias("r"), seq).select("r.*", "ingest_seq")
            parsed = durable(parse_gmail(raw) if inbox_id is None else parse_graph(raw, inbox_id), "parsed")
            messages, bad = split(parsed)
            with_flags(messages).write.mode("overwrite").partitionBy("month").parquet(f"{dst}/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")

    source = spark.readStream.text(src).filter(F.trim("value") != "")
    source = source.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    return _start(source.writeStream.foreachBatch(save).option("checkpointLocation", ckpt), every)


def sweep_stream(
    spark: SparkSession,
    src: str,
    decisions_path: str,
    dst: str,
    ckpt: str,
    schema: T.StructType = MESSAGE,
    every: str | None = None,
) -> StreamingQuery:
    """Sweep requests for new mail under the decisions as they are at each micro-batch.

    Each batch overwrites its own folder, so a batch that is run again changes nothing.
    """

    def sweep(batch: DataFrame, batch_id: int) -> None:
        with scratch_run(batch.sparkSession):
            decisions = batch.sparkSession.read.parquet(decisions_path)
            sweep_plan(batch, decisions).write.mode("overwrite").parquet(f"{dst}/batch={batch_id}")

    writer = message_stream(spark, src, schema).writeStream.foreachBatch(sweep).option("checkpointLocation", ckpt)
    return _start(writer, every)


# Folders that the ids of a run of the index are spread over.
ID_BUCKETS = 32
_SEEN = T.StructType([T.StructField("message_id", T.StringType()), T.StructField("bucket", T.IntegerType())])


def unseen(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """The first row of each message id of ``batch`` that ``seen`` (message_id, bucket) does not hold.

    Mail without an id is one message. Only the folders are read that the batch's ids lie in,
    of which there are at most ID_BUCKETS, and of them only what the ids of the batch match
    is kept, so the index is not shuffled when the batch is small.
    """
    firsts = first_wins(batch, ["message_id"], "ingest_seq").withColumn("bucket", _bucket())
    keys = firsts.select("message_id", "bucket")
    touched = [r["bucket"] for r in keys.select("bucket").distinct().collect()]
    stored = seen.filter(F.col("bucket").isin(touched)).select("message_id", "bucket")
    k, s = keys.alias("k"), stored.alias("s")
    met = s.join(k, (F.col("s.bucket") == F.col("k.bucket")) & F.col("s.message_id").eqNullSafe(F.col("k.message_id")), "left_semi")
    f, m = firsts.alias("f"), met.distinct().alias("m")
    same = (F.col("f.bucket") == F.col("m.bucket")) & F.col("f.message_id").eqNullSafe(F.col("m.message_id"))
    return f.join(m, same, "left_anti")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("message_id"), F.lit(ID_BUCKETS)).cast("int")


def dedupe_stream(
    spark: SparkSession,
    src: str,
    dst: str,
    seen: str,
    ckpt: str,
    schema: T.StructType = MESSAGE,
    every: str | None = None,
    fan: int = FAN,
) -> StreamingQuery:
    """The first arrival of every message id, however late and in whichever order mail comes.

    The ids seen so far are a table in the folder ``seen``, as mail of any age may be pulled
    again; the stream itself has no state. A batch meets the ids of the batches before it only,
    and overwrites its own rows in both tables, so running it again changes nothing. Of equal
    ids in one batch the first by ``ingest_seq`` counts.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        with scratch_run(batch.sparkSession):
            index = RunTable(batch.sparkSession, seen, _SEEN, ["bucket"], fan)
            index.vacuum(batch_id)
            fresh = durable(unseen(batch, index.read(batch_id)), "unseen")
            fresh.drop("bucket").write.mode("overwrite").parquet(f"{dst}/batch={batch_id}")
            index.put(batch_id, fresh.select("message_id", "bucket").repartition("bucket"))
            index.merge(batch_id, lambda rows: rows.repartition("bucket"))

    writer = message_stream(spark, src, schema).writeStream.foreachBatch(save).option("checkpointLocation", ckpt)
    return _start(writer, every)


def by_day_and_thread(messages: DataFrame) -> DataFrame:
    """(day, thread_id, messages, unread) of mail in scope; sums over parts of the mail add up."""
    day = F.date_trunc("day", "date_received").cast("timestamp_ntz").alias("day")
    return in_scope(messages).groupBy(day, "thread_id").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if("is_unread").alias("unread")
    )


def _summed(threads: DataFrame, *more: str) -> DataFrame:
    return threads.groupBy("day", "thread_id", *more).agg(F.sum("messages").alias("messages"), F.sum("unread").alias("unread"))


def digest_of(threads: DataFrame, classifications: DataFrame | None = None) -> DataFrame:
    """The digest of (day, thread_id, messages, unread), one row per day and thread."""
    if classifications is None:
        known = threads.withColumns({"category": F.lit(None).cast("string"), "actionable": F.lit(False)})
    else:
        known = threads.join(classifications.select("thread_id", "category", "actionable"), "thread_id", "left")
    return known.groupBy("day", F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(
        F.sum("messages").alias("messages"),
        F.sum("unread").alias("unread"),
        F.count(F.lit(1)).alias("threads"),
        F.count_if(F.coalesce("actionable", F.lit(False))).alias("actionable"),
    )


def daily_digest(messages: DataFrame, classifications: DataFrame | None = None) -> DataFrame:
    """(day, category, messages, unread, threads, actionable) of mail in scope, per day of receipt.

    ``classifications`` is (thread_id, category, actionable); a thread that it does not
    hold is uncategorized. Threads, and actionable threads, count on each of their days.
    Mail without a date has a row without a day.
    """
    return digest_of(by_day_and_thread(messages), classifications)


# The folder of a day, also for mail without one.
UNDATED = "none"
_THREADS = T.StructType(
    [
        T.StructField("day", T.TimestampNTZType()),
        T.StructField("thread_id", T.StringType()),
        T.StructField("messages", T.LongType()),
        T.StructField("unread", T.LongType()),
        T.StructField("date", T.StringType()),
    ]
)


def touched_days(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of the stored table in the days of ``fresh`` (by ``date``), with those of ``fresh``, summed.

    The days of a batch are few, so they become a filter on the folders that are read.
    """
    days = [r["date"] for r in fresh.select("date").distinct().collect()]
    columns = ["day", "thread_id", "messages", "unread", "date"]
    return _summed(stored.filter(F.col("date").isin(days)).select(*columns).unionByName(fresh.select(*columns)), "date")


def digest_stream(
    spark: SparkSession,
    src: str,
    dst: str,
    threads: str,
    ckpt: str,
    classifications_path: str | None = None,
    schema: T.StructType = MESSAGE,
    every: str | None = None,
    fan: int = FAN,
) -> StreamingQuery:
    """Keep the digest of every day up to date, one folder per day.

    Counts per day and thread are kept in the folder ``threads``, a run per micro-batch. A batch
    reads its own mail and, of the counts before it, those of its days; it overwrites the digest
    of these days only. Late mail changes its day whenever it arrives, and mail without a date
    has a row of its own.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        with scratch_run(session):
            counts = RunTable(session, threads, _THREADS, ["date"], fan)
            counts.vacuum(batch_id)
            date = F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit(UNDATED))
            fresh = durable(by_day_and_thread(batch).withColumn("date", date), "threads")
            counts.put(batch_id, fresh)
            labels = session.read.parquet(classifications_path) if classifications_path else None
            digest = digest_of(touched_days(counts.read(batch_id), fresh), labels)
            digest = digest.withColumn("date", date)
            digest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(dst)
            counts.merge(batch_id, lambda rows: _summed(rows, "date"))

    writer = message_stream(spark, src, schema).writeStream.foreachBatch(save).option("checkpointLocation", ckpt)
    return _start(writer, every)


def running_stats(messages: DataFrame) -> DataFrame:
    """Additive columns of the sender statistics; works on streams (update mode) and tables."""
    return messages.groupBy(sender_key("sender.email").alias("sender_email")).agg(
        F.count(F.lit(1)).alias("email_count"),
        F.count_if("is_unread").alias("unread_count"),
        F.count_if(has_label(messages, STARRED)).alias("starred_count"),
        F.count_if(has_label(messages, INBOX)).alias("inbox_count"),
        F.min("date_received").alias("first_email_date"),
        F.max("date_received").alias("last_email_date"),
    )


def stats_stream(
    spark: SparkSession, src: str, dst: str, ckpt: str, schema: T.StructType = MESSAGE, every: str | None = None
) -> StreamingQuery:
    """Running statistics; each micro-batch writes the senders it changed to its own folder."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_no", F.lit(batch_id)).write.mode("overwrite").parquet(f"{dst}/batch={batch_id}")

    stats = running_stats(message_stream(spark, src, schema))
    writer = stats.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", ckpt)
    return _start(writer, every)
