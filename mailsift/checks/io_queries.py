"""Checked queries on files and streams. Each writes views of the given tables and reads them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.checks.noise_queries import manifest
from mailsift.checks.raw_queries import flat_messages
from mailsift.checks.registry import query
from mailsift.checks.sender_queries import scored_state, texts
from mailsift.checks.views import Views
from mailsift.functions.measure import iso_instant
from mailsift.operators import decisions as dc
from mailsift.operators import normalize
from mailsift.ranking import chunk, number_by_sequence
from mailsift.session import scratch_path
from mailsift.sources import readers, writers
from mailsift.streaming import jobs

FLAT = """SELECT message_id, thread_id, sender_email AS email, sender_name AS name, '' AS to_csv, '' AS cc_csv, subject,
  strftime(date_received, '%Y-%m-%dT%H:%M:%S.%gZ') AS received, category, label_csv AS labels, is_unread FROM v_messages"""


@query(
    "a1_read_messages",
    f"""SELECT f.*, s.read_order FROM ({FLAT}) f JOIN (SELECT message_id, row_number() OVER (ORDER BY ingest_seq) AS read_order FROM v_messages) s USING (message_id)""",
)
def a1(v):
    """Every column, and the rank of the sequence that reading gives."""
    root = scratch_path(v.spark, "shards")
    writers.write_shards(v.messages, root)
    read = readers.read_messages(v.spark, root)
    ranked = number_by_sequence(read, [], "ingest_seq", "read_order")
    return flat_messages(ranked, "read_order")


@query(
    "a5_write_shards",
    "SELECT shard_no, count(*) AS records FROM (SELECT (row_number() OVER (ORDER BY ingest_seq) - 1) // 500 AS shard_no FROM v_messages) GROUP BY 1",
)
def a5(v):
    root = scratch_path(v.spark, "shards")
    writers.write_shards(v.messages, root)
    shards = v.spark.read.text(f"{root}/shard=*/part-*", wholetext=True)
    number = F.regexp_extract("_metadata.file_path", r"shard=(\d+)", 1).cast("bigint") - 1
    return shards.select(number.alias("shard_no"), F.json_array_length("value").cast("bigint").alias("records"))


def _folder_with_runs(v: Views) -> str:
    """A root with all but two categories, one complete recovery run and one failed run."""
    root = scratch_path(v.spark, "mailbox")

    def of(*categories):
        return v.messages.filter(F.col("category").isin(*categories))

    writers.write_shards(of("primary", "social", "promotions"), root)
    for run, status, category in (("run-a", "complete", "updates"), ("run-b", "failed", "forums")):
        folder = f"{root}/backfills/{run}"
        writers.write_shards(of(category), folder)
        _checkpoint(v, folder, run, status)
    return root


def _checkpoint(v: Views, folder: str, run: str, status: str) -> None:
    state = F.to_json(F.struct(F.lit(run).alias("runId"), F.lit(status).alias("status")))
    v.spark.range(1, numPartitions=1).select(state.alias("value")).write.text(f"{folder}/backfill-checkpoint.json")


@query("a2_read_backfill", f"SELECT * FROM ({FLAT}) WHERE category = 'updates'")
def a2(v):
    return flat_messages(readers.read_backfill(v.spark, _folder_with_runs(v)))


@query(
    "a3_load_all",
    "SELECT message_id, subject, category = 'updates' AS from_backfill FROM v_messages WHERE category <> 'forums'",
)
def a3(v):
    loaded = readers.load_all(v.spark, _folder_with_runs(v))
    return loaded.select("message_id", "subject", (F.col("ingest_seq") >= (1 << 48)).alias("from_backfill"))


@query(
    "u2_union_messages",
    """SELECT category, count(*) AS n, count(DISTINCT message_id) AS ids FROM
       (SELECT * FROM v_messages WHERE category IN ('primary', 'updates') UNION ALL SELECT * FROM v_messages WHERE category = 'updates') GROUP BY 1""",
)
def u2(v):
    """Root shards hold two categories; a recovery run holds one of them again."""
    root = scratch_path(v.spark, "mailbox")
    writers.write_shards(v.messages.filter("category IN ('primary', 'updates')"), root)
    writers.write_shards(v.messages.filter("category = 'updates'"), f"{root}/backfills/run-a")
    _checkpoint(v, f"{root}/backfills/run-a", "run-a", "complete")
    counts = readers.load_all(v.spark, root).groupBy("category")
    return counts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("message_id").alias("ids"))


@query("a4_read_recovered", "SELECT message_id, upper(subject) AS subject FROM v_messages")
def a4(v):
    """Each message is staged as a row, a broken line and a corrected row."""
    path = scratch_path(v.spark, "staged")
    first = F.to_json(writers.message_record())
    second = F.to_json(writers.message_record().withField("subject", F.upper("subject")))
    lines = F.array(first, F.lit("{broken"), F.lit('{"messageId": ""}'), second)
    v.messages.select(F.explode(lines).alias("value")).write.text(path)
    return readers.read_recovered(v.spark, path).select("message_id", "subject")


def _envelopes(df: DataFrame, seq: str, record, name: str, label: str, **head) -> str:
    """Write rows as files that hold one JSON object each, 1,000 rows to a file."""
    path = scratch_path(df.sparkSession, label)
    chunked = chunk(df, [], seq, 1000, "file_no")
    listed = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), record.alias("r"))))["r"]
    fixed = [F.lit(value).alias(key) for key, value in head.items()]
    body = chunked.groupBy("file_no").agg(F.to_json(F.struct(F.lit(1).alias("version"), *fixed, listed.alias(name))).alias("value"))
    body.write.partitionBy("file_no").text(path)
    return f"{path}/file_no=*/part-*"


def _renamed(fields: dict[str, str]):
    return [F.col(column).alias(field) for field, column in fields.items()]


@query(
    "a7_read_sender_state",
    """SELECT 'me@x.org' AS mailbox, sender_email, email_count, unread_ratio, sender_type, confidence_tier, extraction_candidate,
       array_to_string(sample_subjects, '|') AS sample_subjects, strftime(last_email_date, '%Y-%m-%dT%H:%M:%S.%gZ') AS last_email_date FROM v_state""",
)
def a7(v):
    fields = {f: c for f, c in readers.STATE_FIELDS.items() if c != "user_decision"}
    times = [iso_instant(c).alias(f) for f, c in readers.STATE_TIMES.items()]
    record = F.struct(*_renamed(fields), *times)
    path = _envelopes(
        scored_state(v), "first_seq", record, "senders", "state", mailbox="me@x.org", generatedAt="2024-02-15T00:00:00.000Z"
    )
    return readers.read_sender_state(v.spark, path).select(
        "mailbox",
        "sender_email",
        "email_count",
        "unread_ratio",
        "sender_type",
        "confidence_tier",
        "extraction_candidate",
        texts("sample_subjects"),
        iso_instant("last_email_date").alias("last_email_date"),
    )


@query("a8_write_sender_state", "SELECT sender_email, email_count, sender_type, confidence_tier FROM v_state")
def a8(v):
    path = scratch_path(v.spark, "state-table")
    writers.write_sender_state(scored_state(v), path)
    return v.spark.read.parquet(path).select("sender_email", "email_count", "sender_type", "confidence_tier")


@query(
    "a9_read_decisions",
    """SELECT run_id, batch_id, sender_email, reviewed_type, user_decision, messages_archived, actions_csv AS actions_taken,
       strftime(decided_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS decided_at,
       row_number() OVER (ORDER BY ((rn - 1) // 1000) :: VARCHAR, rn) AS read_order FROM (SELECT *, row_number() OVER (ORDER BY log_seq) AS rn FROM v_decisions)""",
)
def a9(v):
    """A log of many files: the read sequence orders by file name, then position."""
    log = dc.with_feedback(v.decisions).withColumn("system_recommendation", F.lit("keep")).withColumn("email_count", F.lit(1))
    record = F.struct(*_renamed(readers.DECISION_FIELDS), iso_instant("decided_at").alias("timestamp"))
    path = _envelopes(log, "log_seq", record, "decisions", "log")
    return number_by_sequence(readers.read_decisions(v.spark, path), [], "log_seq", "read_order").select(
        "run_id",
        "batch_id",
        "sender_email",
        "reviewed_type",
        "user_decision",
        "messages_archived",
        texts("actions_taken", ","),
        iso_instant("decided_at").alias("decided_at"),
        "read_order",
    )


@query(
    "a10_read_manifest",
    """SELECT 'r1' AS run_id, sender_email, email_count, presented_sender_type, reviewed_sender_type, user_decision, filter_status, messages_archived FROM v_manifest""",
)
def a10(v):
    m = manifest(v).join(v.flat.groupBy(F.lower("sender_email").alias("sender_email")).agg(F.min("ingest_seq").alias("seq")), "sender_email")
    fields = {f: c for f, c in readers.MANIFEST_FIELDS.items() if c != "last_error"}
    record = F.struct(*_renamed(fields), iso_instant("last_email_date").alias("lastEmailDate"))
    path = _envelopes(m, "seq", record, "senders", "manifest", runId="r1", batchId="b1", status="prepared")
    senders, _ = readers.read_manifest(v.spark, path)
    return senders.select(
        "run_id",
        "sender_email",
        "email_count",
        "presented_sender_type",
        "reviewed_sender_type",
        "user_decision",
        "filter_status",
        "messages_archived",
    )


@query("a14_read_raw_gmail", "SELECT id AS message_id, thread_id, coalesce(subject, '(no subject)') AS subject FROM v_gmail WHERE reason = ''")
def a14(v):
    path = scratch_path(v.spark, "raw-gmail")
    v.raw_gmail.drop("ingest_seq").write.json(path)
    messages, _ = normalize.normalize_gmail(readers.read_raw_gmail(v.spark, path))
    return messages.select("message_id", "thread_id", "subject")


@query("a15_read_raw_graph", "SELECT id AS message_id, lower(sender_email) AS email FROM v_graph WHERE reason = ''")
def a15(v):
    path = scratch_path(v.spark, "raw-graph")
    v.raw_graph.drop("ingest_seq").write.json(path)
    messages, _ = normalize.normalize_graph(readers.read_raw_graph(v.spark, path), "r0")
    return messages.select("message_id", F.col("sender.email").alias("email"))


# --- streams ----------------------------------------------------------------------------


def _source(v: Views) -> tuple[str, DataFrame]:
    """The messages as a folder of files, and the table itself."""
    src = scratch_path(v.spark, "stream-source")
    v.messages.repartitionByRange(10, "ingest_seq").write.parquet(src)
    return src, v.messages


@query("a6_ingest_resume", "SELECT message_id, subject FROM v_messages")
def a6(v):
    """Half of the files, a run, the rest of the files, a restart, and a run with nothing to do."""
    src, dst, ckpt = (scratch_path(v.spark, x) for x in ("source", "sink", "checkpoint"))
    v.messages.filter("is_unread").write.parquet(src)
    schema = v.messages.schema
    jobs.ingest_stream(v.spark, src, dst, ckpt, schema).awaitTermination()
    v.messages.filter("NOT is_unread").write.mode("append").parquet(src)
    for _ in range(2):
        jobs.ingest_stream(v.spark, src, dst, ckpt, schema).awaitTermination()
    return v.spark.read.parquet(dst).select("message_id", "subject")


@query("t1s_ingest_stream", "SELECT message_id, thread_id, category, is_unread FROM v_messages")
def t1s(v):
    src, table = _source(v)
    dst = scratch_path(v.spark, "sink")
    jobs.ingest_stream(v.spark, src, dst, scratch_path(v.spark, "checkpoint"), table.schema).awaitTermination()
    return v.spark.read.parquet(dst).select("message_id", "thread_id", "category", "is_unread")


@query(
    "t1s_pull_stream",
    "SELECT 'gmail' AS dialect, id, reason FROM v_gmail UNION ALL SELECT 'graph' AS dialect, id, reason FROM v_graph",
)
def t1s_pull(v):
    """Raw pages of both dialects into messages and rejects, half of the lines at a time."""
    found = []
    for dialect, raw, inbox in (("gmail", v.raw_gmail, None), ("graph", v.raw_graph, "r0")):
        src, dst, bad, ckpt = (scratch_path(v.spark, x) for x in ("pages", "messages", "rejects", "checkpoint"))
        for part in (0, 1):
            raw.filter(F.col("ingest_seq") % 2 == part).drop("ingest_seq").write.mode("append").json(src)
            jobs.pull_stream(v.spark, src, dst, bad, ckpt, inbox).awaitTermination()
        kept = v.spark.read.parquet(dst).select(F.col("message_id").alias("id"), F.lit("").alias("reason"))
        found += [kept, v.spark.read.parquet(bad).select("id", "reason")]
        found[-2:] = [f.select(F.lit(dialect).alias("dialect"), "id", "reason") for f in found[-2:]]
    return reduce(DataFrame.unionByName, found)


@query(
    "t2s_sweep_stream",
    """SELECT message_id FROM v_messages WHERE list_contains(string_split(label_csv, ','), 'INBOX') AND lower(sender_email) IN (SELECT sender_key FROM v_noise)""",
)
def t2s(v):
    src, table = _source(v)
    log, dst = scratch_path(v.spark, "decisions"), scratch_path(v.spark, "sweeps")
    v.decisions.write.parquet(log)
    jobs.sweep_stream(v.spark, src, log, dst, scratch_path(v.spark, "checkpoint"), table.schema).awaitTermination()
    return v.spark.read.parquet(dst).select(F.explode("message_ids").alias("message_id"))


def _newest_first(v: Views) -> list[DataFrame]:
    """The messages in the order of a pull: the newest half year, what is older, and mail without a date."""
    late = F.col("date_received") >= F.lit("2024-01-15").cast("timestamp_ntz")
    table = v.messages.withColumn("date_received", F.col("date_received").cast("timestamp"))
    return [table.filter(late), table.filter(~late & (F.col("ingest_seq") % 2 == 0)), table.filter(F.coalesce(~late & (F.col("ingest_seq") % 2 == 1), F.lit(True)))]


@query(
    "t3s_digest_stream",
    """SELECT * FROM (WITH m AS (SELECT *, CASE WHEN ingest_seq % 7 = 3 THEN NULL ELSE date_trunc('day', date_received) END AS day FROM v_messages),
       t AS (SELECT day, thread_id, count(*) AS messages, count(*) FILTER (WHERE is_unread) AS unread
       FROM m WHERE NOT list_has_any(string_split(label_csv, ','), ['SPAM', 'TRASH', 'DRAFT', 'SENT']) GROUP BY 1, 2),
       c AS (SELECT DISTINCT thread_id, 'even' AS category, is_unread AS actionable FROM (SELECT thread_id, bool_or(is_unread) AS is_unread, min(ingest_seq) AS s FROM v_messages GROUP BY 1) WHERE s % 2 = 0)
       SELECT day, coalesce(c.category, 'uncategorized') AS category, sum(messages) AS messages, sum(unread) AS unread, count(*) AS threads,
       count(*) FILTER (WHERE coalesce(c.actionable, false)) AS actionable FROM t LEFT JOIN c USING (thread_id) GROUP BY 1, 2)""",
)
def t3s(v):
    """Three runs, newest mail first, with every second thread classified and every seventh message without a date."""
    src, dst, counts, labels, ckpt = (scratch_path(v.spark, x) for x in ("source", "sink", "counts", "labels", "checkpoint"))
    threads = v.messages.groupBy("thread_id").agg(F.max("is_unread").alias("actionable"), F.min("ingest_seq").alias("s"))
    threads.filter("s % 2 = 0").select("thread_id", F.lit("even").alias("category"), "actionable").write.parquet(labels)
    dated = F.when(F.col("ingest_seq") % 7 != 3, F.col("date_received"))
    for part in _newest_first(v):
        part.withColumn("date_received", dated).write.mode("append").parquet(src)
        jobs.digest_stream(v.spark, src, dst, counts, ckpt, labels, part.schema, fan=2).awaitTermination()
    return v.spark.read.parquet(dst).select("day", "category", "messages", "unread", "threads", "actionable")


@query("t4s_dedupe_stream", "SELECT message_id, ingest_seq FROM v_messages")
def t4s(v):
    """Three runs, newest mail first, and then every message once more."""
    src, dst, seen, ckpt = (scratch_path(v.spark, x) for x in ("source", "sink", "seen", "checkpoint"))
    parts = _newest_first(v)
    for part in [*parts, *parts]:
        part.write.mode("append").parquet(src)
        jobs.dedupe_stream(v.spark, src, dst, seen, ckpt, part.schema, fan=2).awaitTermination()
    return v.spark.read.parquet(dst).select("message_id", "ingest_seq")


@query(
    "t5s_running_stats",
    """SELECT lower(sender_email) AS sender_email, count(*) AS email_count, count(*) FILTER (WHERE is_unread) AS unread_count,
       min(date_received) AS first_email_date, max(date_received) AS last_email_date FROM v_messages GROUP BY 1""",
)
def t5s(v):
    """The last state of each sender after two runs over a growing folder."""
    src, dst, ckpt = (scratch_path(v.spark, x) for x in ("source", "sink", "checkpoint"))
    for unread in ("is_unread", "NOT is_unread"):
        v.messages.filter(unread).write.mode("append").parquet(src)
        jobs.stats_stream(v.spark, src, dst, ckpt, v.messages.schema).awaitTermination()
    columns = ["sender_email", "email_count", "unread_count", "first_email_date", "last_email_date"]
    rows = v.spark.read.parquet(dst)
    last = rows.groupBy("sender_email").agg(F.max_by(F.struct(*columns), "batch_no").alias("r"))
    return last.select("r.*")
