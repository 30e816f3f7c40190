"""Checked queries on raw messages, folders, pull errors, data quality and model output."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.checks import ctes
from mailsift.checks.noise_queries import manifest
from mailsift.checks.registry import query
from mailsift.checks.sender_queries import scored_state, stats, texts
from mailsift.checks.thread_queries import classified
from mailsift.checks.views import AS_OF, Views
from mailsift.functions import address, measure
from mailsift.functions import text as tx
from mailsift.operators import backfill as bf
from mailsift.operators import decisions as dc
from mailsift.operators import folders as fd
from mailsift.operators import infer, normalize, quality
from mailsift.operators import threads as th
from mailsift.operators.senders import category_breakdown
from mailsift.plans import composed
from mailsift.ranking import assert_max_rows

# --- normalization ----------------------------------------------------------------------

ctes.CTES["v_gmail"] = """
SELECT *, coalesce(CASE WHEN id IS NULL THEN 'Missing message id' WHEN thread_id = '' THEN 'Missing threadId'
   WHEN no_date = 1 AND bad_date = 0 THEN 'Missing internalDate' WHEN no_from = 1 THEN 'Missing From header'
   WHEN bad_date = 1 OR broken_to = 1 THEN 'Schema validation failed' END, '') AS reason FROM v_raw"""
ctes.CTES["v_graph"] = """
SELECT *, coalesce(CASE WHEN id IS NULL THEN 'Missing id' WHEN no_from = 1 THEN 'Missing from' WHEN broken_to = 1 THEN 'Missing from address'
   WHEN no_date = 1 THEN 'Schema validation failed' END, '') AS reason FROM v_raw"""

CC = "CASE WHEN cc_text IS NULL THEN '' ELSE concat('c', ingest_seq % 7, '@z.org,d@z.org') END"


def flat_messages(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "message_id",
        "thread_id",
        F.col("sender.email").alias("email"),
        F.col("sender.name").alias("name"),
        F.array_join("recipients.to", ",").alias("to_csv"),
        F.array_join("recipients.cc", ",").alias("cc_csv"),
        "subject",
        measure.iso_instant("date_received").alias("received"),
        "category",
        texts("labels", ","),
        "is_unread",
        *more,
    )


TAB = """CASE category WHEN 'primary' THEN 'CATEGORY_PERSONAL' WHEN 'social' THEN 'CATEGORY_SOCIAL' WHEN 'promotions' THEN 'CATEGORY_PROMOTIONS'
  WHEN 'updates' THEN 'CATEGORY_UPDATES' END"""


@query(
    "n1_normalize_gmail",
    f"""SELECT id AS message_id, thread_id, sender_email AS email, CASE WHEN ingest_seq % 4 < 2 THEN sender_name ELSE '' END AS name,
        concat('a', ingest_seq, '@x.org,b', ingest_seq % 9, '@y.org') AS to_csv, {CC} AS cc_csv, coalesce(subject, '(no subject)') AS subject,
        strftime(date_received, '%Y-%m-%dT%H:%M:%S.%gZ') AS received, CASE category WHEN 'forums' THEN 'unknown' ELSE category END AS category,
        concat_ws(',', nullif(label_csv, ''), {TAB}) AS labels, is_unread FROM v_gmail WHERE reason = ''""",
)
def n1(v):
    return flat_messages(normalize.normalize_gmail(v.raw_gmail)[0])


@query("n1_gmail_rejects", "SELECT id, reason FROM v_gmail WHERE reason <> ''")
def n1_rejects(v):
    return normalize.normalize_gmail(v.raw_gmail)[1]


@query(
    "n7_normalize_graph",
    """SELECT id AS message_id, CASE thread_id WHEN '' THEN id ELSE thread_id END AS thread_id, lower(sender_email) AS email, sender_name AS name,
       concat('a', ingest_seq, '@x.org') AS to_csv, CASE WHEN cc_text IS NULL THEN '' ELSE 'd@z.org' END AS cc_csv,
       CASE WHEN coalesce(subject, '') = '' THEN '(no subject)' ELSE subject END AS subject,
       strftime(date_trunc('second', date_received), '%Y-%m-%dT%H:%M:%S.%gZ') AS received, 'unknown' AS category,
       concat_ws(',', CASE WHEN folder_id = 'r0' THEN 'INBOX' END, CASE WHEN is_unread THEN 'UNREAD' END, CASE WHEN ingest_seq % 37 = 0 THEN 'STARRED' END,
         CASE WHEN ingest_seq % 10 = 0 THEN 'IMPORTANT' END, CASE WHEN ingest_seq % 7 = 0 THEN 'Blue,Red' END) AS labels, is_unread
       FROM v_graph WHERE reason = ''""",
)
def n7(v):
    return flat_messages(normalize.normalize_graph(v.raw_graph, "r0")[0])


@query("n7_graph_rejects", "SELECT id, reason FROM v_graph WHERE reason <> ''")
def n7_rejects(v):
    return normalize.normalize_graph(v.raw_graph, "r0")[1]


@query(
    "n8_graph_labels",
    """SELECT ingest_seq, concat_ws(',', CASE WHEN folder_id = 'r0' THEN 'INBOX' END, CASE WHEN is_unread THEN 'UNREAD' END, CASE WHEN ingest_seq % 37 = 0 THEN 'STARRED' END,
       CASE WHEN ingest_seq % 10 = 0 THEN 'IMPORTANT' END, CASE WHEN ingest_seq % 7 = 0 THEN 'Blue,Red' END) AS labels FROM v_raw""",
)
def n8(v):
    return v.raw_graph.select("ingest_seq", F.array_join(normalize.graph_labels("r0"), ",").alias("labels"))


@query(
    "n9_graph_recipients",
    """SELECT ingest_seq, concat('a', ingest_seq, '@x.org') AS to_csv, CASE WHEN cc_text IS NULL THEN '' ELSE 'd@z.org' END AS cc_csv FROM v_raw""",
)
def n9(v):
    return v.raw_graph.select(
        "ingest_seq",
        F.array_join(normalize.graph_recipients("toRecipients"), ",").alias("to_csv"),
        F.array_join(normalize.graph_recipients("ccRecipients"), ",").alias("cc_csv"),
    )


@query(
    "n2_from_header",
    """SELECT ingest_seq, sender_email AS email, CASE WHEN ingest_seq % 4 < 2 THEN sender_name ELSE '' END AS name FROM v_raw""",
)
def n2(v):
    return v.raw.select("ingest_seq", address.from_header("from_text").alias("f")).select("ingest_seq", "f.email", "f.name")


@query(
    "n3_address_list",
    f"SELECT ingest_seq, concat('a', ingest_seq, '@x.org,b', ingest_seq % 9, '@y.org') AS to_csv, {CC} AS cc_csv FROM v_raw",
)
def n3(v):
    return v.raw.select(
        "ingest_seq",
        F.array_join(address.address_list("to_text"), ",").alias("to_csv"),
        F.array_join(address.address_list(F.coalesce("cc_text", F.lit(""))), ",").alias("cc_csv"),
    )


@query(
    "n4_header",
    "SELECT ingest_seq, CASE WHEN no_from = 1 THEN NULL ELSE from_text END AS from_text, subject, cc_text FROM v_raw",
)
def n4(v):
    headers = "payload.headers"
    return v.raw_gmail.select(
        "ingest_seq",
        address.header(headers, "From").alias("from_text"),
        address.header(headers, "subject").alias("subject"),
        address.header(headers, "Cc").alias("cc_text"),
    )


@query(
    "n6_unread_and_subject",
    "SELECT id AS message_id, is_unread, coalesce(subject, '(no subject)') AS subject FROM v_gmail WHERE reason = ''",
)
def n6(v):
    return normalize.normalize_gmail(v.raw_gmail)[0].select("message_id", "is_unread", "subject")


@query("n5_category", "SELECT ingest_seq, CASE category WHEN 'forums' THEN 'unknown' ELSE category END AS category FROM v_raw")
def n5(v):
    return v.raw_gmail.select("ingest_seq", address.infer_category("labelIds").alias("category"))


@query(
    "n10_bodies",
    """SELECT id AS message_id, CASE WHEN ingest_seq % 3 = 0 THEN concat('Hi ', sender_email) ELSE concat('Grüße: ', from_text) END AS body FROM v_raw""",
)
def n10(v):
    return normalize.extract_bodies(v.raw_gmail)


# --- folders ----------------------------------------------------------------------------


@query("j9_folder_closure", "SELECT id FROM v_closure")
def j9(v):
    return fd.folder_closure(v.folders, fd.excluded_roots(v.folders))


@query(
    "p2_excluded_folders",
    """SELECT ingest_seq FROM v_raw WHERE folder_id NOT IN (SELECT id FROM v_closure) AND folder_id NOT IN (WITH RECURSIVE d(id) AS
       (SELECT 'r0' UNION SELECT f.id FROM v_folders f JOIN d ON f.parent_id = d.id) SELECT id FROM d)""",
)
def p2(v):
    """The folder of deleted items has a name in another language; its id is well known."""
    well_known = v.folders.filter("display_name = 'Gelöschte Elemente'").select("id")
    return fd.drop_excluded_folders(v.raw_graph, v.folders, well_known).select("ingest_seq")


@query(
    "g18_folder_estimate",
    "SELECT CAST(sum(total_items) AS BIGINT) AS estimate FROM v_folders WHERE id NOT IN (SELECT id FROM v_closure)",
)
def g18(v):
    return fd.folder_estimate(v.folders, fd.folder_closure(v.folders, fd.excluded_roots(v.folders)))


# --- pull errors ------------------------------------------------------------------------


def starred(v: Views) -> DataFrame:
    """Staged rows of a recovery: starred mail came back, each row twice."""
    own = v.messages.filter(F.array_contains("labels", "STARRED"))
    again = own.withColumn("subject", F.lit("again")).withColumn("ingest_seq", F.col("ingest_seq") + (1 << 40))
    return own.unionByName(again)


@query("p8_error_level", "SELECT error_seq, level FROM v_leveled")
def p8(v):
    return bf.error_level(v.errors).select("error_seq", "level")


@query("x10_legacy_ids", "SELECT error_seq, named_id FROM v_leveled")
def x10(v):
    return v.errors.select("error_seq", tx.legacy_message_id("message").alias("named_id"))


@query("g15_recovery_ids", "SELECT message_id FROM v_targets")
def g15(v):
    return bf.recovery_ids(v.errors)


@query(
    "x11_fingerprint",
    """SELECT CAST(sum(n) AS BIGINT) AS ids, sha256(string_agg(b || ':' || d, chr(10) ORDER BY b)) AS fingerprint FROM
       (SELECT h[1:4] AS b, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS d FROM
        (SELECT DISTINCT sha256(message_id) AS h FROM v_targets) GROUP BY 1)""",
)
def x11(v):
    return bf.fingerprint(bf.recovery_ids(v.errors))


@query(
    "g14_pull_statistics",
    "SELECT 'fetched' AS measure, count(*) AS n FROM v_messages UNION ALL SELECT concat('errors_', level), count(*) FROM v_leveled GROUP BY 1",
)
def g14(v):
    return bf.pull_statistics(v.messages, v.errors)


def residuals(v: Views) -> DataFrame:
    return v.errors.select("error_seq", "message", F.coalesce("message_id", tx.legacy_message_id("message")).alias("message_id")).filter(
        "message_id IS NOT NULL"
    )


ctes.CTES["v_residual"] = """
SELECT message_id, max(error_seq) AS error_seq FROM (SELECT coalesce(message_id, named_id) AS message_id, error_seq FROM v_leveled)
WHERE message_id IN (SELECT message_id FROM v_targets) AND message_id NOT IN (SELECT message_id FROM v_recovered) GROUP BY 1"""


@query("j16_residual_errors", "SELECT message_id, error_seq FROM v_residual")
def j16(v):
    return bf.residual_errors(residuals(v), bf.recovery_ids(v.errors), starred(v)).select("message_id", "error_seq")


NEW_ERRORS = """SELECT error_seq, level FROM v_leveled WHERE level = 'system' OR coalesce(message_id, named_id) IS NULL
  OR coalesce(message_id, named_id) NOT IN (SELECT message_id FROM v_messages WHERE list_contains(string_split(label_csv, ','), 'STARRED'))"""


@query("u3_new_errors", NEW_ERRORS)
def u3(v):
    return bf.new_errors(v.errors, starred(v).select("message_id").distinct()).select("error_seq", "level")


REPORT = """SELECT (SELECT count(*) FROM v_targets) AS targets, count(*) AS recovered, (SELECT count(*) FROM v_residual) AS still_failing,
  CAST(ceil(count(*) / 500) AS BIGINT) AS shards FROM v_recovered"""


@query("g16_backfill_report", REPORT)
def g16(v):
    return composed.backfill_merge(v.errors, starred(v), residuals(v))["report"]


@query(
    "s31_backfill_merge",
    """SELECT 'recovered' AS part, message_id AS id FROM v_recovered UNION ALL SELECT 'residual', message_id FROM v_residual
       UNION ALL SELECT 'error', CAST(error_seq AS VARCHAR) FROM v_leveled WHERE level = 'system' OR coalesce(message_id, named_id) IS NULL
         OR coalesce(message_id, named_id) NOT IN (SELECT message_id FROM v_recovered)""",
)
def s31(v):
    merged = composed.backfill_merge(v.errors, starred(v), residuals(v))

    def part(name, table, column):
        return merged[table].select(F.lit(name).alias("part"), F.col(column).cast("string").alias("id"))

    return (
        part("recovered", "recovered", "message_id")
        .unionByName(part("residual", "residual", "message_id"))
        .unionByName(part("error", "errors", "error_seq"))
    )


@query(
    "j5_pending_bodies",
    """SELECT message_id FROM v_messages WHERE NOT (list_contains(string_split(label_csv, ','), 'INBOX') AND is_unread)""",
)
def j5(v):
    done = v.messages.filter(F.array_contains("labels", "INBOX"))
    return bf.pending_bodies(v.messages, done, v.messages.filter("is_unread"))


@query("p9_max_rows", "SELECT category, count(*) AS emails FROM v_messages GROUP BY 1")
def p9(v):
    return assert_max_rows(category_breakdown(v.messages), 10_000, "categories")


# --- data quality -----------------------------------------------------------------------


@query(
    "q1_check_messages",
    """SELECT message_id AS key, 'sender' AS rule, concat('x ', sender_email) AS value FROM v_messages WHERE ingest_seq % 9 = 0
       UNION ALL SELECT message_id, 'category', 'news' FROM v_messages WHERE category = 'forums'""",
)
def q1(v):
    bad = F.when(F.col("ingest_seq") % 9 == 0, F.concat(F.lit("x "), "sender.email")).otherwise(F.col("sender.email"))
    broken = v.messages.withColumn("sender", F.struct(bad.alias("email"), F.col("sender.name").alias("name")))
    return quality.check_messages(
        broken.withColumn("category", F.when(F.col("category") == "forums", "news").otherwise(F.col("category")))
    )


@query(
    "q2_check_stats",
    """SELECT sender_email AS key, 'email_count' AS rule, CAST(email_count - 80 AS VARCHAR) AS value FROM v_stats WHERE email_count < 80
       UNION ALL SELECT sender_email, 'sender_type', 'robot' FROM v_stats WHERE category = 'social'""",
)
def q2(v):
    s = stats(v).withColumn("email_count", F.col("email_count") - 80)
    return quality.check_stats(s.withColumn("sender_type", F.when(F.col("category") == "social", "robot").otherwise("human")))


@query(
    "q3_check_state",
    "SELECT lower(sender_email) AS key, 'unique_sender' AS rule, CAST(count(DISTINCT sender_email) AS VARCHAR) AS value FROM v_messages GROUP BY 1 HAVING count(DISTINCT sender_email) > 1",
)
def q3(v):
    return quality.check_state(v.flat.select("sender_email").distinct())


@query(
    "q4_check_log",
    """SELECT sender_email AS key, 'corrected_needs_type' AS rule, 'corrected' AS value FROM v_decisions WHERE reviewed_type IS NULL AND user_decision = 'keep'""",
)
def q4(v):
    feedback = F.when(F.col("user_decision") == "keep", "corrected").otherwise(F.col("feedback"))
    return quality.check_log(dc.with_feedback(v.decisions).withColumn("feedback", feedback))


@query(
    "q5_check_manifest",
    """SELECT sender_email AS key, 'log_status' AS rule, 'skipped' AS value FROM v_manifest WHERE user_decision = 'keep'
       UNION ALL SELECT sender_email, 'messages_archived', CAST(messages_archived - 20 AS VARCHAR) FROM v_manifest WHERE messages_archived < 20""",
)
def q5(v):
    status = F.when(F.col("user_decision") == "keep", "skipped").otherwise(F.col("log_status"))
    broken = manifest(v).withColumn("log_status", status)
    return quality.check_manifest(broken.withColumn("messages_archived", F.col("messages_archived") - 20))


@query(
    "q6_check_classifications",
    """SELECT thread_id AS key, 'confidence' AS rule, CAST(confidence + CAST(0.5 AS DOUBLE) AS VARCHAR) AS value FROM v_classified
       WHERE confidence + CAST(0.5 AS DOUBLE) > 1""",
)
def q6(v):
    return quality.check_classifications(classified(v).withColumn("confidence", F.col("confidence") + F.lit(0.5)))


# --- models -----------------------------------------------------------------------------


def by_length(thread: pd.DataFrame, categories: list[str]) -> pd.DataFrame:
    """A deterministic stand-in for a thread model that fails for some threads."""
    size = len(thread["content"][0])
    if size % 5 == 0:
        raise RuntimeError(f"no answer at {size}")
    return pd.DataFrame(
        {
            "thread_id": thread["thread_id"],
            "category": "long" if size > 1000 else "short",
            "confidence": size % 10 / 10,
            "actionable": size % 2 == 0,
            "summary": f"one of {len(categories)}, {size} characters",
        }
    )


SCORED = f"""SELECT h.thread_id, CASE WHEN n % 5 = 0 THEN 'uncategorized' WHEN n > 1000 THEN 'long' ELSE 'short' END AS category,
        CASE WHEN n % 5 = 0 THEN 0 ELSE CAST(n % 10 AS DOUBLE) / 10 END AS confidence,
        n % 5 <> 0 AND n % 2 = 0 AND last_date >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AS actionable,
        CASE WHEN n % 5 = 0 THEN 'Classification failed.' ELSE concat('one of ', (SELECT count(DISTINCT category) FROM v_by_rule), ', ', n, ' characters') END AS summary,
        'llm' AS classified_by, CAST(NULL AS VARCHAR) AS rule_name
        FROM (SELECT h.*, length(coalesce(c.content, '')) AS n FROM v_heads h JOIN v_parts c USING (thread_id)) h
        WHERE h.thread_id NOT IN (SELECT thread_id FROM v_by_rule)"""


@query("f1_score_threads", f"{SCORED} UNION ALL SELECT thread_id, category, confidence, actionable, summary, classified_by, rule_name FROM v_by_rule")
def f1(v):
    """Rules first, then a model that fails for some threads; only those fall back."""
    run = composed.run_classification(v.mail, v.bodies, v.rules, by_length, AS_OF)
    return run["classifications"].select("thread_id", "category", "confidence", "actionable", "summary", "classified_by", "rule_name")


def ambiguous(v: Views) -> DataFrame:
    return composed.ambiguous_senders(stats(v))


def prompts(v: Views) -> DataFrame:
    return infer.sender_prompts(ambiguous(v), dc.few_shot(dc.with_feedback(v.decisions), 50))


@query(
    "s16_sender_prompts",
    """SELECT prompt_no, email, name, domain, subjects, email_count, category, CAST(unread_ratio AS DOUBLE) AS unread_ratio, thread_count FROM
       (SELECT (row_number() OVER (ORDER BY first_seq) - 1) // 50 AS prompt_no, sender_email AS email, sender_name AS name,
        split_part(sender_email, '@', 2) AS domain, array_to_string(sample_subjects, '|') AS subjects, email_count, category,
        floor(unread_ratio * 100 + CAST(0.5 AS DOUBLE)) / 100 AS unread_ratio, thread_count FROM v_heuristic WHERE heuristic_type = 'unknown')""",
)
def s16(v):
    """The payload of every prompt, item by item; the order of items is that of its e-mails."""
    item = "array<struct<email:string,name:string,domain:string,subjects:array<string>,emailCount:bigint,gmailCategory:string,unreadRatio:double,threadCount:bigint>>"
    items = prompts(v).select("prompt_no", F.posexplode(F.from_json("payload", item)).alias("pos", "i"), "emails")
    return items.filter(F.col("emails")[F.col("pos")] == F.col("i.email")).select(
        "prompt_no",
        "i.email",
        "i.name",
        "i.domain",
        F.array_join("i.subjects", "|").alias("subjects"),
        F.col("i.emailCount").alias("email_count"),
        F.col("i.gmailCategory").alias("category"),
        F.col("i.unreadRatio").alias("unread_ratio"),
        F.col("i.threadCount").alias("thread_count"),
    )


def answer(instructions: str, payload: str) -> str:
    """A deterministic stand-in for a sender model, with text around the JSON."""
    import json

    rows = [
        {"email": s["email"].upper(), "senderType": "company" if s["threadCount"] % 2 else "bot", "confidence": 0.7}
        for s in json.loads(payload)
    ]
    return f"Thinking [not json]. Answer: {json.dumps(rows)} Done."


RESULTS = """SELECT sender_email AS email, CASE WHEN thread_count % 2 = 1 THEN 'company' ELSE 'unknown' END AS sender_type,
  CASE WHEN thread_count % 2 = 1 THEN CAST(0.7 AS DOUBLE) ELSE 0 END AS confidence FROM v_heuristic WHERE heuristic_type = 'unknown'"""


@query("f2_score_senders", RESULTS)
def f2(v):
    asked = prompts(v)
    return infer.parse_sender_results(infer.score_senders(asked, answer), asked).select("email", "sender_type", "confidence")


@query(
    "s14_parse_results",
    """SELECT thread_id AS email, CASE WHEN n % 2 = 0 THEN 'human' ELSE 'unknown' END AS sender_type,
       CASE WHEN n % 2 = 0 THEN CAST(0.25 AS DOUBLE) ELSE 0 END AS confidence FROM (SELECT thread_id, count(*) AS n FROM v_messages GROUP BY 1)""",
)
def s14(v):
    """One response per thread; threads of odd size get only invalid entries."""
    sizes = v.messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))
    numbered = sizes.withColumn("prompt_no", F.xxhash64("thread_id"))
    kind = F.when(F.col("n") % 2 == 0, "human").otherwise("robot")
    entry = F.concat(
        F.lit('So [1, 2]: [{"email":"'), F.upper("thread_id"), F.lit('","senderType":"'), kind, F.lit('","confidence":0.25},'),
        F.lit('{"email":"'), "thread_id", F.lit('","senderType":"company","confidence":2},{"email":"x","senderType":"human","confidence":1}]'),
    )
    responses = numbered.select("prompt_no", entry.alias("response"))
    asked = numbered.select("prompt_no", F.array("thread_id").alias("emails"))
    return infer.parse_sender_results(responses, asked).select("email", "sender_type", "confidence")


@query(
    "x12_json_payload",
    """SELECT page_id, CASE page_id % 3 WHEN 2 THEN NULL ELSE url END AS url FROM pages""",
)
def x12(v):
    body = F.to_json(F.struct("url"))
    kind = F.col("page_id") % 3
    output = F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 1, body)
    output = output.otherwise(F.concat(F.lit("Sorry: "), body))
    return v.table("pages").select("page_id", F.from_json(tx.json_payload(output), "url string")["url"].alias("url"))


@query(
    "f3_propose_taxonomy",
    """SELECT DISTINCT concat('Topic ', conv_id % 9) AS category FROM conversations WHERE conv_id IN
       (SELECT CAST(substr(thread_id, 2) AS BIGINT) FROM v_heads ORDER BY md5(thread_id), thread_id LIMIT 1000)""",
)
def f3(v):
    def subjects(summaries: list[str]) -> list[str]:
        return sorted({s.split("\n")[0].removeprefix("Subject: ") for s in summaries})

    sample = th.taxonomy_sample(th.thread_heads(v.mail), th.thread_entries(v.mail, v.bodies))
    return infer.propose_taxonomy(sample, subjects)
