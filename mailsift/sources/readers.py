"""Readers of the JSON edge formats. Inside the engine all tables are Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.functions.address import NO_SUBJECT, is_email
from mailsift.ranking import computed_once, last_wins, number_by_order
from mailsift.schema import (
    CATEGORIES,
    DECISION_JSON,
    MANIFEST_JSON,
    MESSAGE_JSON,
    RAW_GMAIL,
    RAW_GRAPH,
    SENDER_STATE_JSON,
)
from mailsift.session import durable
from mailsift.sources.json_arrays import checked_objects, elements, listed

# Shards of a folder: files named batch-NNNNN.json, or one file in each folder shard=NNNNN.
SHARD_GLOBS = ["batch-*.json", "shard=*/part-*"]
SHARD_NAME = r"(?:/batch-(\d{5,})\.json|/shard=(\d{5,})/part-[^/]*)$"
# Layout of ingest_seq: place of the file among the files in order, position in the file.
# Files of recovery runs come after all files of the root, of which there are fewer than FILES.
POSITION_BITS, FILES = 16, 1 << 32
# The same for files of lines and for logs.
LINE_BITS = 40
RUN_FOLDER = r"/backfills/([^/]+)/"


def _existing(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The patterns that match at least one file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def matches(pattern: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(conf).globStatus(path)
        return found is not None and len(found) > 0

    return [p for p in patterns if matches(p)]


def _ranked_files(files: DataFrame, *order: str) -> DataFrame:
    """(file, file_no): files numbered from 0 in an order, by ranges; no task holds all of them."""
    ranked = number_by_order(files.select("file", *order), [], [*order, "file"], "file_no")
    return ranked.select("file", (F.col("file_no") - 1).alias("file_no"))


def _text_or(c: Column, default: str) -> Column:
    return F.coalesce(c, F.lit(default))


def _to_messages(record: Column, seq: Column) -> list[Column]:
    none = F.array().cast("array<string>")
    return [
        record["messageId"].alias("message_id"),
        record["threadId"].alias("thread_id"),
        F.struct(record["sender"]["email"].alias("email"), _text_or(record["sender"]["name"], "").alias("name")).alias("sender"),
        F.struct(
            F.coalesce(record["recipients"]["to"], none).alias("to"),
            F.coalesce(record["recipients"]["cc"], none).alias("cc"),
        ).alias("recipients"),
        _text_or(record["subject"], NO_SUBJECT).alias("subject"),
        F.try_to_timestamp(record["dateReceived"]).alias("date_received"),
        _text_or(record["gmailCategory"], "unknown").alias("category"),
        F.coalesce(record["labels"], none).alias("labels"),
        record["isUnread"].alias("is_unread"),
        _text_or(record["snippet"], "").alias("snippet"),
        seq.alias("ingest_seq"),
    ]


def _valid_record(record: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(
        (record["messageId"] != "")
        & (record["threadId"] != "")
        & is_email(record["sender"]["email"])
        & F.forall(F.coalesce(record["recipients"]["to"], none), is_email)
        & F.forall(F.coalesce(record["recipients"]["cc"], none), is_email)
        & F.try_to_timestamp(record["dateReceived"]).isNotNull()
        & F.coalesce(record["gmailCategory"], F.lit("unknown")).isin(CATEGORIES)
        & record["isUnread"].isNotNull(),
        F.lit(False),
    )


def _empty_messages(spark: SparkSession) -> DataFrame:
    record = F.from_json(F.lit("{}"), MESSAGE_JSON)
    return spark.range(0).select(*_to_messages(record, F.col("id")))


def _shard_records(spark: SparkSession, paths: list[str], runs: DataFrame | None = None) -> DataFrame:
    """(file, file_no, pos, record) of all shard records, or those of ``runs``; a file that is no JSON array fails.

    Files are in order of their run, if any, and of their digits as a text.
    """
    digits = F.coalesce(
        F.nullif(F.regexp_extract("file", SHARD_NAME, 1), F.lit("")),
        F.nullif(F.regexp_extract("file", SHARD_NAME, 2), F.lit("")),
    )
    of_run = F.lit("") if runs is None else F.regexp_extract("file", RUN_FOLDER, 1)
    files = listed(spark, paths).withColumns({"digits": digits, "run": of_run}).filter("digits is not null")
    order = _ranked_files(files, "run", "digits")
    if runs is not None:
        files = files.join(runs, "run", "left_semi")
        order = order.join(files.select("file"), "file", "left_semi")
    objects = checked_objects(spark, paths, files=files)
    record = F.from_json("text", MESSAGE_JSON, {"mode": "FAILFAST"}).alias("record")
    return objects.join(order, "file").select("file", "file_no", "pos", record)


def _seq(first_file: int) -> Column:
    too_long = F.raise_error(F.concat(F.lit("shard has too many records: "), "file"))
    pos = F.when(F.col("pos") < (1 << POSITION_BITS), F.col("pos")).otherwise(too_long).cast("bigint")
    return F.shiftleft(F.col("file_no") + first_file, POSITION_BITS) + pos


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, seq) of the lines of text files that are not blank, in order of file and line.

    The number of a line does not depend on how files are split into tasks: a line's place
    in its split is added to the lines of the splits before, of which there is one row each.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    # Written down, so that the text is read once; the counts read three narrow columns of it.
    lines = durable(lines, "lines")
    splits = lines.groupBy("file", "block").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    splits = splits.join(_ranked_files(splits.select("file").distinct()), "file")
    place = F.shiftleft("file_no", LINE_BITS) + F.col("before") + F.col("line") - F.col("first")
    return lines.join(splits, ["file", "block"]).filter(F.trim("value") != "").select("value", place.alias("seq"))


def _messages(records: DataFrame, first_file: int, mode: str) -> DataFrame:
    record = F.col("record")
    if mode == "FAILFAST":
        fail = F.raise_error(F.concat(F.lit("invalid record in "), "file"))
        records = records.withColumn("record", F.when(_valid_record(record), record).otherwise(fail))
    else:
        records = computed_once(records).filter(_valid_record(record))
    return records.select(*_to_messages(F.col("record"), _seq(first_file)))


def read_messages(spark: SparkSession, root: str, mode: str = "FAILFAST") -> DataFrame:
    """All shards of a folder in name order; one bad record fails the load.

    With ``mode="DROP"`` bad records are left out; ``read_rejects`` returns them.
    """
    paths = _existing(spark, [f"{root}/{g}" for g in SHARD_GLOBS])
    if not paths:
        return _empty_messages(spark)
    return _messages(_shard_records(spark, paths), 0, mode)


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    """(file, pos, record as JSON) of invalid records."""
    paths = _existing(spark, [f"{root}/{g}" for g in SHARD_GLOBS])
    bad = computed_once(_shard_records(spark, paths)).filter(~_valid_record(F.col("record")))
    return bad.select("file", "pos", F.to_json("record").alias("record"))


def read_backfill(spark: SparkSession, root: str) -> DataFrame:
    """Shards of the recovery runs that are complete; a run with an unreadable checkpoint is skipped."""
    paths = _existing(spark, [f"{root}/backfills/*/{g}" for g in SHARD_GLOBS])
    checks = _existing(spark, [f"{root}/backfills/*/backfill-checkpoint.json"])
    if not paths or not checks:
        return _empty_messages(spark)
    state = F.from_json("value", "runId string, status string")
    runs = (
        spark.read.text(checks, wholetext=True)
        .select(F.regexp_extract("_metadata.file_path", RUN_FOLDER, 1).alias("run"), state.alias("s"))
        .filter((F.col("s.status") == "complete") & F.col("s.runId").isNotNull())
    )
    return _messages(_shard_records(spark, paths, runs.select("run")), FILES, "FAILFAST")


def load_all(spark: SparkSession, root: str) -> DataFrame:
    """Root shards, then complete recovery runs; repeated message ids are kept."""
    return read_messages(spark, root).unionByName(read_backfill(spark, root))


def read_recovered(spark: SparkSession, path: str) -> DataFrame:
    """Append-only staged JSON lines; bad lines are skipped and the last row per id wins."""
    parsed = _numbered_lines(spark, path).select(F.from_json("value", MESSAGE_JSON).alias("record"), "seq")
    good = computed_once(parsed).filter(_valid_record(F.col("record")))
    kept = good.groupBy(F.col("record.messageId").alias("_id")).agg(F.max_by(F.struct("record", "seq"), "seq").alias("_r"))
    return kept.select(*_to_messages(F.col("_r.record"), F.col("_r.seq")))


def _envelope(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """A file holding one JSON object; None when there is no such file."""
    if not _existing(spark, [path]):
        return None
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _snake(record: str, fields: dict[str, str]) -> list[Column]:
    return [F.col(f"{record}.{source}").alias(target) for source, target in fields.items()]


STATE_FIELDS = {
    "senderEmail": "sender_email",
    "senderName": "sender_name",
    "emailCount": "email_count",
    "gmailCategory": "category",
    "unreadRatio": "unread_ratio",
    "threadCount": "thread_count",
    "sampleSubjects": "sample_subjects",
    "starredCount": "starred_count",
    "importantCount": "important_count",
    "confidenceTier": "confidence_tier",
    "recommendedAction": "recommended_action",
    "surprisesFlag": "surprises_flag",
    "userDecision": "user_decision",
    "senderType": "sender_type",
    "senderTypeConfidence": "sender_type_confidence",
    "senderTypeSource": "sender_type_source",
    "extractionCandidate": "extraction_candidate",
    "reviewedSenderType": "reviewed_sender_type",
}
STATE_TIMES = {
    "firstEmailDate": "first_email_date",
    "lastEmailDate": "last_email_date",
    "reviewedAt": "reviewed_at",
    "processedAt": "processed_at",
}


def read_sender_state(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of a sender state file; None when there is none, an error when it is corrupt."""
    if not _existing(spark, [path]):
        return None
    objects, around = elements(spark, [path], "senders")
    strict = {"mode": "FAILFAST"}
    header = around.select("file", F.from_json("text", "mailbox string, generatedAt string", strict).alias("h"))
    parsed = objects.select("file", F.from_json("text", SENDER_STATE_JSON, strict).alias("s"))
    rows = parsed.join(header, "file").select("h.mailbox", "h.generatedAt", "s")
    # Without senders the header is still looked at, so that a corrupt file is an error.
    corrupt = computed_once(header.filter(F.length(F.to_json("h")) < 0).select("h.mailbox"))
    rows = rows.unionByName(corrupt, allowMissingColumns=True)
    times = [F.to_timestamp(f"s.{source}").alias(target) for source, target in STATE_TIMES.items()]
    return rows.select(
        "mailbox", F.to_timestamp("generatedAt").alias("generated_at"), *_snake("s", STATE_FIELDS), *times
    )


DECISION_FIELDS = {
    "runId": "run_id",
    "batchId": "batch_id",
    "senderEmail": "sender_email",
    "senderName": "sender_name",
    "presentedSenderType": "presented_type",
    "reviewedSenderType": "reviewed_type",
    "senderTypeFeedback": "feedback",
    "systemRecommendation": "system_recommendation",
    "userDecision": "user_decision",
    "emailCount": "email_count",
    "messagesArchived": "messages_archived",
    "actionsTaken": "actions_taken",
}


def read_decisions(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of decision log files; ``log_seq`` orders them by file name, then position."""
    if not _existing(spark, [path]):
        return None
    files = listed(spark, [path])
    objects = checked_objects(spark, [path], "decisions", files)
    parsed = objects.select("file", "pos", F.from_json("text", DECISION_JSON, {"mode": "FAILFAST"}).alias("d"))
    rows = parsed.join(_ranked_files(files), "file")
    return rows.select(
        *_snake("d", DECISION_FIELDS),
        F.to_timestamp("d.timestamp").alias("decided_at"),
        (F.shiftleft("file_no", LINE_BITS) + F.col("pos")).alias("log_seq"),
    )


MANIFEST_FIELDS = {
    "senderEmail": "sender_email",
    "senderName": "sender_name",
    "emailCount": "email_count",
    "unreadRatio": "unread_ratio",
    "presentedSenderType": "presented_sender_type",
    "reviewedSenderType": "reviewed_sender_type",
    "systemRecommendation": "system_recommendation",
    "userDecision": "user_decision",
    "filterApplied": "filter_applied",
    "filterStatus": "filter_status",
    "archiveStatus": "archive_status",
    "logStatus": "log_status",
    "stateStatus": "state_status",
    "sheetStatus": "sheet_status",
    "messagesArchived": "messages_archived",
    "lastError": "last_error",
}


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(sender rows, header row) of a batch manifest file."""
    envelope = _envelope(spark, path, MANIFEST_JSON)
    if envelope is None:
        return None
    header = envelope.select(
        F.col("runId").alias("run_id"),
        F.col("batchId").alias("batch_id"),
        F.col("batchType").alias("batch_type"),
        F.col("groupingReason").alias("grouping_reason"),
        F.col("presentedRecommendation").alias("presented_recommendation"),
        "status",
        F.col("createdAt").alias("created_at"),
        "summary",
    )
    rows = envelope.select("runId", "batchId", "status", F.posexplode("senders").alias("pos", "s"))
    senders = rows.select(
        F.col("runId").alias("run_id"),
        F.col("batchId").alias("batch_id"),
        "status",
        (F.col("pos") + 1).alias("position"),
        *_snake("s", MANIFEST_FIELDS),
        F.to_timestamp("s.lastEmailDate").alias("last_email_date"),
    )
    return senders, header


def normalize_rules(entries: DataFrame) -> DataFrame:
    """Rules (kind, rule_key, category, seq) with lower-case keys; of equal keys the last wins."""
    lowered = entries.withColumn("rule_key", F.lower("rule_key"))
    return last_wins(lowered, ["kind", "rule_key"], "seq").select("kind", "rule_key", "category")


def load_rules(spark: SparkSession, path: str) -> DataFrame | None:
    """Rules file of two maps as rows (kind, rule_key, category)."""
    maps = T.MapType(T.StringType(), T.StringType())
    envelope = _envelope(
        spark, path, T.StructType([T.StructField("domainRules", maps), T.StructField("senderRules", maps)])
    )
    if envelope is None:
        return None

    def entries(kind: str) -> DataFrame:
        return envelope.select(
            F.lit(kind).alias("kind"), F.posexplode(F.map_entries(f"{kind}Rules")).alias("seq", "e")
        ).select("kind", F.col("e.key").alias("rule_key"), F.col("e.value").alias("category"), "seq")

    return normalize_rules(entries("domain").unionByName(entries("sender")))


def read_raw_gmail(spark: SparkSession, path: str) -> DataFrame:
    """Gmail-shaped raw messages, one JSON object per line, numbered by file and line."""
    return _raw(spark, path, RAW_GMAIL)


def read_raw_graph(spark: SparkSession, path: str) -> DataFrame:
    """Graph-shaped raw messages, one JSON object per line, numbered by file and line."""
    return _raw(spark, path, RAW_GRAPH)


def _raw(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    lines = _numbered_lines(spark, path)
    return lines.select(F.from_json("value", schema).alias("r"), F.col("seq").alias("ingest_seq")).select("r.*", "ingest_seq")
