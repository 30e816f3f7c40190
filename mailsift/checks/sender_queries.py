"""Checked queries on senders: statistics, scores, types, state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.checks import ctes
from mailsift.checks.registry import query
from mailsift.checks.views import AS_OF, STORED_BEFORE, Views
from mailsift.functions import address, measure
from mailsift.operators import scoring, senders, state
from mailsift.operators.review import audit_rows, read_audit_decisions
from mailsift.plans import composed

NOW = "2024-02-16 08:00:00"


def texts(name: str, sep: str = "|"):
    return F.array_join(name, sep).alias(name)


def seconds(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


# --- shared intermediate tables -------------------------------------------------------


def stats(v: Views) -> DataFrame:
    return senders.sender_stats(v.messages)


def sender_results(s: DataFrame) -> DataFrame:
    """Stand-in model results for named senders."""
    third, half = F.col("email_count") % 3, F.col("email_count") % 2
    return s.filter("sender_name <> ''").select(
        F.col("sender_email").alias("email"),
        F.when(third == 0, "company").when(third == 1, "newsletter").otherwise("human").alias("sender_type"),
        F.when(half == 0, 0.8).otherwise(0.65).alias("confidence"),
    )


def enriched(v: Views) -> DataFrame:
    s = stats(v)
    return composed.enrich(s, sender_results(s))


def scored_state(v: Views) -> DataFrame:
    return scoring.score_confidence(enriched(v), AS_OF)


def stored_state(v: Views) -> DataFrame:
    """State as an earlier run over the mail known by then left it."""
    old = senders.sender_stats(v.messages.filter(F.col("date_received") < measure.at(STORED_BEFORE)))
    n = F.col("email_count")
    user = n % 3 == 0
    return old.select(
        "sender_email",
        F.when(n % 4 == 0, "human").when(n % 4 == 1, "company").when(n % 4 == 2, "newsletter").alias("sender_type"),
        (F.expr("0.5D") + F.expr("0.1D") * (n % 5)).alias("sender_type_confidence"),
        F.when(user, "user").when(n % 3 == 1, "llm").otherwise("heuristic").alias("sender_type_source"),
        (n % 2 == 0).alias("extraction_candidate"),
        F.when(n % 6 == 0, "automated").alias("reviewed_sender_type"),
        F.when(user, measure.at("2024-01-10 00:00:00")).alias("reviewed_at"),
        F.when(user, measure.at("2024-01-11 00:00:00")).alias("processed_at"),
        F.lit("keep").alias("user_decision"),
        "email_count",
        "thread_count",
        "first_email_date",
        "last_email_date",
    )


def fresh_state(v: Views) -> DataFrame:
    even, n = F.col("email_count") % 2 == 0, F.col("email_count")
    return (
        stats(v)
        .withColumn("sender_type", F.when(even, "company"))
        .withColumn("sender_type_confidence", F.when(even, F.expr("0.5D") + F.expr("0.1D") * (n % 4)))
        .withColumn("sender_type_source", F.when(even, "llm"))
    )


# --- statistics -----------------------------------------------------------------------

STATS_COLUMNS = """sender_email, sender_name, email_count, first_email_date, last_email_date, category, unread_ratio,
  thread_count, starred_count, important_count, array_to_string(sample_subjects, '|') AS sample_subjects"""


@query("g1_sender_stats", f"SELECT {STATS_COLUMNS} FROM v_stats")
def g1(v):
    return stats(v).select(
        "sender_email",
        "sender_name",
        "email_count",
        "first_email_date",
        "last_email_date",
        "category",
        "unread_ratio",
        "thread_count",
        "starred_count",
        "important_count",
        texts("sample_subjects"),
    )


@query("g2_modal_category", "SELECT sender_email, category FROM v_stats")
def g2(v):
    return senders.modal_category(v.messages)


@query("g3_display_name", "SELECT sender_email, sender_name FROM v_stats")
def g3(v):
    return senders.display_name(v.messages)


@query("w1_sample_subjects", "SELECT sender_email, array_to_string(sample_subjects, '|') AS sample_subjects FROM v_stats")
def w1(v):
    return senders.sample_subjects(v.messages).select("sender_email", texts("sample_subjects"))


@query(
    "w2_top_category",
    """SELECT sender_email, category FROM (SELECT lower(sender_email) AS sender_email, category, row_number() OVER
       (PARTITION BY lower(sender_email) ORDER BY count(*) DESC, min(ingest_seq)) AS rn FROM v_messages GROUP BY 1, 2) WHERE rn = 1""",
)
def w2(v):
    return senders.top_category(senders.category_counts_per_sender(v.messages))


@query(
    "w12_leaderboard",
    """SELECT sender_email, email_count, rank() OVER (ORDER BY email_count DESC) AS rank FROM
       (SELECT sender_email, email_count FROM v_stats ORDER BY email_count DESC, first_seq LIMIT 50)""",
)
def w12(v):
    return senders.leaderboard(stats(v), 50).select("sender_email", "email_count", F.col("rank").cast("bigint"))


@query("o1_by_volume", "SELECT sender_email, email_count FROM v_stats ORDER BY email_count DESC, first_seq")
def o1(v):
    return senders.order_by_volume(stats(v)).select("sender_email", "email_count")


@query(
    "w13_review_batches",
    """SELECT sender_type, sender_email, email_count, rn AS position, (rn - 1) // 50 + 1 AS batch_no,
       list_position(['newsletter','automated','company','human','unknown'], sender_type) AS type_order FROM
       (SELECT *, row_number() OVER (PARTITION BY sender_type ORDER BY email_count DESC, sender_email) AS rn FROM v_state)""",
)
def w13(v):
    return senders.review_batches(scored_state(v)).select(
        "sender_type", "sender_email", "email_count", "position", "batch_no", F.col("type_order").cast("int")
    )


@query(
    "g13_type_breakdown",
    """SELECT t.sender_type, count(s.sender_email) AS senders FROM
       (SELECT unnest(['human','company','newsletter','automated','unknown']) AS sender_type) t
       LEFT JOIN v_state s USING (sender_type) GROUP BY 1""",
)
def g13(v):
    return senders.type_breakdown(scored_state(v))


@query("g21_category_breakdown", "SELECT category, count(*) AS emails FROM v_messages GROUP BY 1")
def g21(v):
    return senders.category_breakdown(v.messages)


@query("g22_monthly_volume", "SELECT strftime(date_received, '%Y-%m') AS month, count(*) AS emails FROM v_messages GROUP BY 1")
def g22(v):
    return senders.monthly_volume(v.messages)


@query(
    "g23_notification_senders",
    """SELECT CASE WHEN split_part(sender_email, '@', 1) IN ('noreply','no-reply','notifications') THEN 'notification' ELSE 'other' END AS kind,
       count(*) AS senders, CAST(sum(email_count) AS BIGINT) AS emails FROM v_stats GROUP BY 1""",
)
def g23(v):
    return senders.notification_senders(stats(v))


# --- scores ---------------------------------------------------------------------------

SCORE = "sender_email, round(noise_score, 9) AS noise_score, confidence_tier, recommended_action, surprises_flag"


def _score(df):
    return df.select(
        "sender_email", F.round("noise_score", 9).alias("noise_score"), "confidence_tier", "recommended_action", "surprises_flag"
    )


@query("s1_confidence", f"SELECT {SCORE} FROM ({ctes.scored('v_stats', kind='NULL')})")
def s1(v):
    return _score(scoring.score_confidence(stats(v), AS_OF))


@query("s3_confidence_o365", f"SELECT {SCORE} FROM ({ctes.scored('v_enriched', 'o365')})")
def s3(v):
    return _score(scoring.score_confidence(enriched(v), AS_OF, "o365"))


@query(
    "s8_heuristic_type",
    "SELECT sender_email, heuristic_type, round(heuristic_confidence, 9) AS heuristic_confidence FROM v_heuristic",
)
def s8(v):
    return scoring.classify_heuristic(stats(v)).select(
        "sender_email", "heuristic_type", F.round("heuristic_confidence", 9).alias("heuristic_confidence")
    )


@query(
    "s15_extraction",
    f"SELECT sender_email, {ctes.extraction('heuristic_type')} AS extraction_candidate FROM v_heuristic",
)
def s15(v):
    typed = scoring.classify_heuristic(stats(v)).withColumn("sender_type", F.col("heuristic_type"))
    return scoring.score_extraction(typed).select("sender_email", "extraction_candidate")


@query(
    "s12_enrich",
    """SELECT sender_email, sender_type, round(sender_type_confidence, 9) AS sender_type_confidence, sender_type_source,
       extraction_candidate FROM v_enriched""",
)
def s12(v):
    return enriched(v).select(
        "sender_email",
        "sender_type",
        F.round("sender_type_confidence", 9).alias("sender_type_confidence"),
        "sender_type_source",
        "extraction_candidate",
    )


@query(
    "s12_analyze",
    """SELECT sender_email, email_count, thread_count, sender_type, sender_type_source, extraction_candidate, confidence_tier,
       recommended_action, surprises_flag FROM v_state""",
)
def s12_analyze(v):
    """The main job as one call, from messages to scored senders, with no state stored before."""
    results = sender_results(stats(v))
    scored = composed.analyze(v.messages, stored_state(v).limit(0), results, AS_OF)
    return scored.select(
        "sender_email",
        "email_count",
        "thread_count",
        "sender_type",
        "sender_type_source",
        "extraction_candidate",
        "confidence_tier",
        "recommended_action",
        "surprises_flag",
    )


@query(
    "j17_sender_results",
    """SELECT s.sender_email, coalesce(r.result_type, 'unknown') AS sender_type,
       coalesce(CAST(r.result_confidence AS DOUBLE), 0) AS sender_type_confidence
       FROM v_stats s LEFT JOIN v_sender_results r ON r.email = s.sender_email""",
)
def j17(v):
    s = stats(v)
    return state.apply_sender_results(s, sender_results(s)).select(
        "sender_email", "sender_type", "sender_type_confidence"
    )


# --- state ----------------------------------------------------------------------------

_FILL = "CASE WHEN o.sender_type_source = 'user' THEN {u} WHEN o.sender_type_source = 'llm' AND f.sender_type_source = 'llm' AND " \
    "coalesce(o.sender_type_confidence, 0) >= coalesce(f.sender_type_confidence, 0) THEN o.{c} ELSE coalesce(f.{c}, o.{c}) END AS {c}"
MERGED = f"""SELECT f.sender_email, f.email_count,
  {_FILL.format(c='sender_type', u='coalesce(o.reviewed_sender_type, o.sender_type)')},
  {_FILL.format(c='sender_type_confidence', u='o.sender_type_confidence')},
  {_FILL.format(c='sender_type_source', u="'user'")},
  o.reviewed_sender_type, o.reviewed_at, o.extraction_candidate, o.processed_at, {{decision}} AS user_decision
  FROM v_fresh f LEFT JOIN v_stored o USING (sender_email)"""
MERGED_COLUMNS = """sender_email, email_count, sender_type, round(sender_type_confidence, 6) AS sender_type_confidence,
  sender_type_source, reviewed_sender_type, reviewed_at, extraction_candidate, processed_at, user_decision"""


def _merged(df):
    return df.select(
        "sender_email",
        "email_count",
        "sender_type",
        F.round("sender_type_confidence", 6).alias("sender_type_confidence"),
        "sender_type_source",
        "reviewed_sender_type",
        "reviewed_at",
        "extraction_candidate",
        "processed_at",
        "user_decision",
    )


@query("j1_merge_state", f"SELECT {MERGED_COLUMNS} FROM ({MERGED.format(decision='CAST(NULL AS VARCHAR)')})")
def j1(v):
    return _merged(state.merge_state(fresh_state(v), stored_state(v), "gmail"))


@query("s17_merge_state_o365", f"SELECT {MERGED_COLUMNS} FROM ({MERGED.format(decision='o.user_decision')})")
def s17(v):
    return _merged(state.merge_state(fresh_state(v), stored_state(v), "o365"))


@query(
    "j13_combine_mailboxes",
    """SELECT coalesce(a.sender_email, b.sender_email) AS sender_email,
       coalesce(a.email_count, 0) + coalesce(b.email_count, 0) AS email_count,
       coalesce(a.thread_count, 0) + coalesce(b.thread_count, 0) AS thread_count,
       least(a.first_email_date, b.first_email_date) AS first_email_date, greatest(a.last_email_date, b.last_email_date) AS last_email_date,
       a.sender_email IS NOT NULL AS in_first, b.sender_email IS NOT NULL AS in_second
       FROM v_stats a FULL JOIN (SELECT lower(sender_email) AS sender_email, count(*) AS email_count, count(DISTINCT thread_id) AS thread_count,
         min(date_received) AS first_email_date, max(date_received) AS last_email_date FROM v_mail GROUP BY 1) b
       ON a.sender_email = b.sender_email""",
)
def j13(v):
    return senders.combine_mailboxes(stats(v), senders.sender_stats(v.mail))


@query(
    "s33_rescore_candidates",
    """SELECT sender_email, sender_type, sender_type_confidence FROM v_state
       WHERE (sender_type = 'unknown' OR sender_type_confidence < CAST(0.7 AS DOUBLE))
       AND sender_email NOT IN (SELECT sender_key FROM v_latest WHERE run_id IN ('r0', 'r1'))""",
)
def s33(v):
    from mailsift.operators.decisions import latest_decisions

    run = F.col("run_id")
    batches = latest_decisions(v.decisions).select(
        F.when(run == "r0", "prepared").when(run == "r1", "executing").otherwise("completed").alias("status"),
        "sender_email",
    )
    return state.rescore_candidates(scored_state(v), batches).select(
        "sender_email", "sender_type", "sender_type_confidence"
    )


@query(
    "j12_contact_links",
    """SELECT DISTINCT c.name, s.sender_email, s.email_count FROM (SELECT contact_id, name, phone, lower(trim(email)) AS email FROM v_contacts UNION SELECT contact_id, name, phone, lower(trim(second_email)) FROM v_contacts) c JOIN v_stats s ON c.email = s.sender_email""",
)
def j12(v):
    return state.contact_links(v.contacts, stats(v)).select("name", "sender_email", "email_count")


@query(
    "s34_identity_links",
    """SELECT c.contact_id, c.name, coalesce(c.phone, '') AS phones, count(*) AS senders, CAST(sum(s.email_count) AS BIGINT) AS email_count,
       max(s.last_email_date) AS last_email_date, arg_max(s.sender_type, (s.email_count, s.sender_email)) AS sender_type
       FROM (SELECT contact_id, name, phone, lower(trim(email)) AS email FROM v_contacts UNION SELECT contact_id, name, phone, lower(trim(second_email)) FROM v_contacts) c JOIN v_state s ON c.email = s.sender_email GROUP BY 1, 2, 3""",
)
def s34(v):
    return state.identity_links(v.contacts, scored_state(v))


# --- audit ----------------------------------------------------------------------------

AUDIT = """SELECT sender_email, sender_name, email_count, strftime(first_email_date, '%Y-%m-%dT%H:%M:%S.%gZ') AS first_email_date,
  strftime(last_email_date, '%Y-%m-%dT%H:%M:%S.%gZ') AS last_email_date, category,
  concat(CAST(floor(unread_ratio * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT), '%') AS unread_ratio, thread_count,
  array_to_string(sample_subjects, ' | ') AS sample_subjects, confidence_tier, recommended_action,
  CASE WHEN surprises_flag THEN 'Yes' ELSE 'No' END AS surprises_flag, '' AS user_decision, sender_type,
  CASE WHEN extraction_candidate THEN 'Yes' ELSE 'No' END AS extraction_candidate, '' AS processed FROM v_state"""


@query("a12_audit_rows", AUDIT)
def a12(v):
    return audit_rows(scored_state(v))


def audit_log(v: Views) -> DataFrame:
    """All decisions as a reviewer might have typed them into the audit table."""
    seq = F.col("log_seq")
    typed = F.when(seq % 7 == 0, "").when(seq % 11 == 0, "maybe").when(seq % 5 == 0, F.upper("user_decision"))
    return v.decisions.select(
        F.concat(F.lit(" "), "sender_email", F.lit(" ")).alias("sender_email"),
        typed.otherwise(F.concat(F.lit(" "), "user_decision")).alias("user_decision"),
        seq.alias("row_no"),
    )


@query(
    "a13_audit_decisions",
    """SELECT sender_email, user_decision AS decision FROM (SELECT *, row_number() OVER (PARTITION BY sender_email ORDER BY log_seq DESC) AS rn
       FROM v_decisions WHERE log_seq % 7 <> 0 AND (log_seq % 11 <> 0)) WHERE rn = 1""",
)
def a13(v):
    return read_audit_decisions(audit_log(v))[0]


@query(
    "a13_audit_invalid",
    """SELECT sender_email, count(*) AS n FROM v_decisions WHERE log_seq % 7 <> 0 AND log_seq % 11 = 0 GROUP BY 1""",
)
def a13_invalid(v):
    return read_audit_decisions(audit_log(v))[1].groupBy("sender_email").agg(F.count(F.lit(1)).alias("n"))


# --- column expressions ---------------------------------------------------------------


@query(
    "x1_address_parts",
    f"""SELECT message_id, lower(split_part(sender_email, '@', 2)) AS host, lower(split_part(sender_email, '@', 1)) AS local_part,
       regexp_matches(lower(sender_email), '^[^@]*@(.*\\.)?{ctes.MARKETING}$') AS marketing FROM v_messages""",
)
def x1(v):
    e = F.col("sender.email")
    return v.messages.select(
        "message_id",
        address.domain(e).alias("host"),
        address.local_part(e).alias("local_part"),
        address.in_domains(address.domain(e), scoring.MARKETING_DOMAINS).alias("marketing"),
    )


@query(
    "x4_dates",
    f"""SELECT message_id, strftime(date_received, '%Y-%m-%d') AS ymd, strftime(date_received, '%Y/%m/%d') AS query_date,
       strftime(date_received, '%Y-%m-%dT%H:%M:%S.%gZ') AS instant,
       date_received >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AS recent FROM v_messages""",
)
def x4(v):
    d = "date_received"
    return v.messages.select(
        "message_id",
        measure.ymd(d).alias("ymd"),
        measure.query_date(d).alias("query_date"),
        measure.iso_instant(d).alias("instant"),
        measure.within_days(d, AS_OF).alias("recent"),
    )


@query(
    "x7_numbers",
    """SELECT event_id, CAST(floor(value / 100 * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS pct,
       floor(value * 100 + CAST(0.5 AS DOUBLE)) / 100 AS two, format('{:,}', event_id * 1000) AS big FROM events""",
)
def x7(v):
    return v.table("events").select(
        "event_id",
        measure.whole_percent(F.col("value") / F.lit(100.0)).alias("pct"),
        measure.two_decimals("value").alias("two"),
        measure.thousands(F.col("event_id") * 1000).alias("big"),
    )


@query("x2_local_part", "SELECT DISTINCT sender_email, lower(split_part(sender_email, '@', 1)) AS local_part FROM v_messages")
def x2(v):
    return v.flat.select("sender_email").distinct().select("sender_email", address.local_part("sender_email").alias("local_part"))


@query(
    "x3_freemail_domain",
    f"SELECT sender_email, email_count, regexp_matches(sender_email, '@(.*\\.)?(yahoo\\.co\\.uk|gmail\\.com|example\\.org)$') AS listed FROM v_stats",
)
def x3(v):
    listed = address.in_domains(address.domain("sender_email"), ["yahoo.co.uk", "gmail.com", "example.org"])
    return stats(v).select("sender_email", "email_count", listed.alias("listed"))


@query("x5_query_dates", "SELECT strftime(date_received, '%Y/%m/%d') AS query_date, count(*) AS n FROM v_messages GROUP BY 1")
def x5(v):
    return v.messages.groupBy(measure.query_date("date_received").alias("query_date")).agg(F.count(F.lit(1)).alias("n"))


@query("x6_iso_instants", "SELECT message_id, strftime(date_received, '%Y-%m-%dT%H:%M:%S.%gZ') AS instant FROM v_mail")
def x6(v):
    return v.mail.select("message_id", measure.iso_instant("date_received").alias("instant"))


@query("x8_two_decimals", "SELECT sender_email, floor(unread_ratio * 100 + CAST(0.5 AS DOUBLE)) / 100 AS ratio FROM v_stats")
def x8(v):
    return stats(v).select("sender_email", measure.two_decimals("unread_ratio").alias("ratio"))


@query("x9_thousands", "SELECT doc_id, format('{:,}', n_chars * 1000) AS chars FROM documents")
def x9(v):
    return v.table("documents").select("doc_id", measure.thousands(F.col("n_chars") * 1000).alias("chars"))


@query(
    "x14_within_a_year",
    f"SELECT thread_id, last_date >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AS recent FROM v_heads",
)
def x14(v):
    from mailsift.operators.threads import thread_heads

    return thread_heads(v.mail).select("thread_id", measure.within_days("last_date", AS_OF).alias("recent"))


OVERRIDES = "split_part(sender_email, '@', 1) IN ('noreply','no-reply','notifications')"


@query("s2_noreply_override", f"SELECT sender_email, confidence_tier, recommended_action FROM v_state WHERE {OVERRIDES}")
def s2(v):
    noreply = address.local_part("sender_email").isin(scoring.NOREPLY_LOCAL_PARTS)
    return scored_state(v).filter(noreply).select("sender_email", "confidence_tier", "recommended_action")


@query("s4_noise_score", "SELECT sender_email, round(noise_score, 9) AS noise_score FROM v_state WHERE noise_score IS NOT NULL")
def s4(v):
    scored = scored_state(v).filter(F.col("noise_score").isNotNull())
    return scored.select("sender_email", F.round("noise_score", 9).alias("noise_score"))


@query(
    "s5_type_noise",
    """SELECT sender_type, category, count(*) AS senders, round(min(noise_score), 9) AS low, round(max(noise_score), 9) AS high
       FROM v_state GROUP BY 1, 2""",
)
def s5(v):
    return scored_state(v).groupBy("sender_type", "category").agg(
        F.count(F.lit(1)).alias("senders"),
        F.round(F.min("noise_score"), 9).alias("low"),
        F.round(F.max("noise_score"), 9).alias("high"),
    )


@query("s6_tiers", "SELECT confidence_tier, recommended_action, count(*) AS senders FROM v_state GROUP BY 1, 2")
def s6(v):
    return scored_state(v).groupBy("confidence_tier", "recommended_action").agg(F.count(F.lit(1)).alias("senders"))


@query("s7_surprises", "SELECT sender_email, surprises_flag FROM v_state")
def s7(v):
    return scored_state(v).select("sender_email", "surprises_flag")
