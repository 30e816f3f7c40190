"""Checked queries on decisions, sweeps, filters and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.checks import ctes
from mailsift.checks.registry import query
from mailsift.checks.sender_queries import NOW, scored_state, texts
from mailsift.checks.views import AS_OF, Views
from mailsift.operators import decisions as dc
from mailsift.operators import filters as fl
from mailsift.operators import noise, review
from mailsift.operators.packing import pack_or_queries
from mailsift.operators.state import apply_review
from mailsift.plans import reports
from mailsift.ranking import last_wins

# --- decisions --------------------------------------------------------------------------

LATEST = "sender_key, run_id, batch_id, user_decision, decided_at, log_seq"


@query("w3_latest_decisions", f"SELECT {LATEST} FROM v_latest")
def w3(v):
    return dc.latest_decisions(v.decisions).select(*LATEST.split(", "))


@query(
    "w4_last_wins",
    """SELECT thread_id, message_id, ingest_seq FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ingest_seq DESC) AS rn
       FROM v_messages) WHERE rn = 1""",
)
def w4(v):
    return last_wins(v.flat.select("thread_id", "message_id", "ingest_seq"), ["thread_id"], "ingest_seq")


@query(
    "w5_latest_in_run",
    """SELECT sender_key, user_decision, log_seq FROM (SELECT *, lower(sender_email) AS sender_key, row_number() OVER
       (PARTITION BY lower(sender_email) ORDER BY log_seq DESC) AS rn FROM v_decisions WHERE run_id = 'r1') WHERE rn = 1""",
)
def w5(v):
    return dc.latest_in_run(v.decisions, "r1").select("sender_key", "user_decision", "log_seq")


@query(
    "w6_upsert_decisions",
    """SELECT run_id, batch_id, lower(sender_email) AS sender_key, arg_max(user_decision, log_seq) AS user_decision, min(log_seq) AS log_seq
       FROM v_decisions GROUP BY 1, 2, 3""",
)
def w6(v):
    early, late = F.col("category") == "updates", F.col("category") != "updates"
    log = v.decisions
    first = log.join(v.flat.filter(early).select(F.col("ingest_seq").alias("log_seq")), "log_seq", "left_semi")
    then = log.join(v.flat.filter(late).select(F.col("ingest_seq").alias("log_seq")), "log_seq", "left_semi")
    return dc.upsert_decisions(first, then).select(
        "run_id", "batch_id", F.lower("sender_email").alias("sender_key"), "user_decision", "log_seq"
    )


FEEDBACK = """CASE WHEN reviewed_type IS NULL THEN 'none' WHEN reviewed_type <> presented_type THEN 'corrected' ELSE 'confirmed' END"""


@query(
    "w10_few_shot",
    f"""SELECT sender_email, CASE WHEN f = 'corrected' THEN reviewed_type ELSE presented_type END AS sender_type, f AS context, log_seq
        FROM (SELECT *, {FEEDBACK} AS f FROM v_decisions) WHERE f <> 'none' ORDER BY CASE f WHEN 'corrected' THEN 0 ELSE 1 END, log_seq LIMIT 50""",
)
def w10(v):
    return dc.few_shot(dc.with_feedback(v.decisions), 50)


@query("s21_noise_senders", "SELECT sender_key, action FROM v_noise")
def s21(v):
    return dc.noise_senders(v.decisions)


@query("o3_order_noise", "SELECT sender_key, action FROM v_noise ORDER BY action = 'unsubscribe', sender_key")
def o3(v):
    return dc.order_noise(dc.noise_senders(v.decisions))


@query(
    "g10_run_dashboard",
    """SELECT count(*) AS processed, CAST(coalesce(sum(messages_archived), 0) AS BIGINT) AS emails_cleared,
       count(*) FILTER (WHERE user_decision = 'unsubscribe') AS unsubscribed,
       count(*) FILTER (WHERE list_contains(string_split(actions_csv, ','), 'filter')) AS senders_filtered,
       (SELECT count(*) FROM v_stats) AS total_senders, greatest((SELECT count(*) FROM v_stats) - count(*), 0) AS remaining
       FROM (SELECT *, row_number() OVER (PARTITION BY lower(sender_email) ORDER BY log_seq DESC) AS rn FROM v_decisions WHERE run_id = 'r2') WHERE rn = 1""",
)
def g10(v):
    senders = v.flat.select(F.lower("sender_email")).distinct()
    return dc.run_dashboard(v.decisions, "r2", senders)


@query(
    "j20_not_yet_logged",
    """SELECT e.sender_email, e.run_id, e.batch_id FROM (SELECT sender_email, 'r1' AS run_id, concat('b', email_count % 3) AS batch_id FROM v_stats) e
       WHERE NOT EXISTS (SELECT 1 FROM v_decisions d WHERE d.run_id = e.run_id AND d.batch_id = e.batch_id AND lower(d.sender_email) = e.sender_email)""",
)
def j20(v):
    from mailsift.checks.sender_queries import stats

    entries = stats(v).select(
        "sender_email", F.lit("r1").alias("run_id"), F.concat(F.lit("b"), F.col("email_count") % 3).alias("batch_id")
    )
    return dc.not_yet_logged(entries, v.decisions)


# --- sweep, archive ---------------------------------------------------------------------


@query(
    "p4_inbox_from",
    """SELECT message_id FROM v_messages WHERE list_contains(string_split(label_csv, ','), 'INBOX')
       AND lower(sender_email) IN (SELECT sender_key FROM v_latest WHERE user_decision = 'unsubscribe')""",
)
def p4(v):
    chosen = dc.latest_decisions(v.decisions).filter("user_decision = 'unsubscribe'")
    return noise.inbox_from(v.messages, chosen).select("message_id")


NOISE_INBOX = """SELECT message_id, ingest_seq FROM v_messages WHERE list_contains(string_split(label_csv, ','), 'INBOX')
  AND lower(sender_email) IN (SELECT sender_key FROM v_noise)"""


@query("j15_noise_in_inbox", f"SELECT message_id FROM ({NOISE_INBOX})")
def j15(v):
    return noise.noise_in_inbox(v.messages, dc.noise_senders(v.decisions)).select("message_id")


@query(
    "s23_sweep_plan",
    f"""SELECT chunk_no, count(*) AS ids, string_agg(message_id, ',' ORDER BY ingest_seq) AS message_ids, '_noise' AS add_labels, 'INBOX' AS remove_labels
        FROM (SELECT *, (row_number() OVER (ORDER BY ingest_seq) - 1) // 1000 AS chunk_no FROM ({NOISE_INBOX})) GROUP BY 1""",
)
def s23(v):
    return noise.sweep_plan(v.messages, v.decisions).select(
        "chunk_no", "ids", texts("message_ids", ","), texts("add_labels", ","), texts("remove_labels", ",")
    )


@query(
    "w9_cap_per_sender",
    """SELECT sender_key, message_id, n > 40 AS truncated FROM (SELECT lower(sender_email) AS sender_key, message_id,
        row_number() OVER (PARTITION BY lower(sender_email) ORDER BY ingest_seq) AS rn, count(*) OVER (PARTITION BY lower(sender_email)) AS n
        FROM v_messages WHERE lower(sender_email) IN (SELECT sender_key FROM v_noise ORDER BY sender_key LIMIT 30)) WHERE rn <= 40""",
)
def w9(v):
    return noise.cap_per_sender(v.messages, dc.noise_senders(v.decisions), 40, 30).select(
        "sender_key", "message_id", "truncated"
    )


@query(
    "s24_archive_plan",
    """SELECT sender_key, chunk_no, count(*) AS ids, string_agg(message_id, ',' ORDER BY ingest_seq) AS message_ids, '_noise' AS add_labels, 'INBOX' AS remove_labels FROM
       (SELECT lower(sender_email) AS sender_key, message_id, ingest_seq,
         (row_number() OVER (PARTITION BY lower(sender_email) ORDER BY ingest_seq) - 1) // 1000 AS chunk_no
        FROM v_messages WHERE lower(sender_email) IN (SELECT sender_key FROM v_noise)) GROUP BY 1, 2""",
)
def s24(v):
    return noise.archive_plan(v.messages, dc.noise_senders(v.decisions)).select(
        "sender_key", "chunk_no", "ids", texts("message_ids", ","), texts("add_labels", ","), texts("remove_labels", ",")
    )


@query(
    "s25_filter_plan",
    """SELECT sender_key AS from_addr, action, '_noise' AS add_labels, CASE action WHEN 'filter' THEN 'INBOX' ELSE 'INBOX,UNREAD' END AS remove_labels FROM v_noise""",
)
def s25(v):
    return noise.filter_plan(v.decisions).select("from_addr", "action", texts("add_labels", ","), texts("remove_labels", ","))


@query(
    "u4_noise_category",
    """SELECT message_id, CASE WHEN label_csv = '' THEN '_noise' ELSE array_to_string(list_sort(list_distinct(list_append(string_split(label_csv, ','), '_noise'))), ',') END AS merged
       FROM v_messages""",
)
def u4(v):
    return noise.add_noise_category(v.messages).select(
        "message_id", F.array_join(F.array_sort("merged_labels"), ",").alias("merged")
    )


# Greedy packing as a recursive walk over the sorted list.
PACK = """
SELECT {group}, batch_no, string_agg(sender, ',' ORDER BY pos) AS senders,
  concat('{pre}', string_agg('from:' || sender, ' OR ' ORDER BY pos), '{post}') AS query FROM
 (WITH RECURSIVE walk AS (
   SELECT {group}, pos, sender, {over} + 5 + length(sender) AS len, 1 AS items, 0 AS batch_no FROM {source} WHERE pos = 1
   UNION ALL
   SELECT n.{group}, n.pos, n.sender,
     CASE WHEN w.items >= {items} OR w.len + 9 + length(n.sender) > 1200 THEN {over} + 5 + length(n.sender) ELSE w.len + 9 + length(n.sender) END,
     CASE WHEN w.items >= {items} OR w.len + 9 + length(n.sender) > 1200 THEN 1 ELSE w.items + 1 END,
     CASE WHEN w.items >= {items} OR w.len + 9 + length(n.sender) > 1200 THEN w.batch_no + 1 ELSE w.batch_no END
   FROM walk w JOIN {source} n ON n.{group} = w.{group} AND n.pos = w.pos + 1)
  SELECT * FROM walk) GROUP BY 1, 2"""
ctes.CTES["v_pack_in"] = """SELECT category AS grp, sender, row_number() OVER (PARTITION BY category ORDER BY sender) AS pos FROM
  (SELECT DISTINCT category, lower(sender_email) AS sender FROM v_messages)"""
ctes.CTES["v_sweep_in"] = """SELECT 0 AS grp, sender_key AS sender, row_number() OVER (ORDER BY action = 'unsubscribe', sender_key) AS pos FROM v_noise"""


@query("w8_pack_queries", "SELECT grp, batch_no, senders, query FROM (" + PACK.format(group="grp", source="v_pack_in", over=0, items=100000, pre="", post="") + ")")
def w8(v):
    pairs = v.flat.select(F.col("category").alias("grp"), F.lower("sender_email").alias("sender")).distinct()
    return pack_or_queries(pairs, ["grp"]).select("grp", F.col("batch_no").cast("int"), texts("senders", ","), "query")


SWEEP_QUERIES = "SELECT batch_no, senders, query FROM (" + PACK.format(group="grp", source="v_sweep_in", over=11, items=25, pre="in:inbox (", post=")") + ")"


@query("w8_sweep_queries", SWEEP_QUERIES)
def w8_sweep(v):
    packed = noise.sweep_queries(dc.noise_senders(v.decisions))
    return packed.select(F.col("batch_no").cast("int"), texts("senders", ","), "query")


@query(
    "g19_sweep_summary",
    f"SELECT count(*) AS messages_found, count(*) AS messages_swept, (SELECT count(*) FROM ({SWEEP_QUERIES})) AS queries FROM ({NOISE_INBOX})",
)
def g19(v):
    queries = noise.sweep_queries(dc.noise_senders(v.decisions))
    return noise.sweep_summary(noise.sweep_plan(v.messages, v.decisions), queries)


# --- filters ----------------------------------------------------------------------------

SET = "array_to_string(list_sort(list_distinct(string_split({}, ','))), ',')"
ctes.CTES["v_classed"] = f"""
SELECT f.*, d.user_decision AS decision, CASE WHEN {SET.format('remove_csv')} NOT IN ('INBOX', 'INBOX,UNREAD') THEN 'other'
   WHEN d.user_decision IN ('filter', 'unsubscribe') THEN 'legacy-noise' WHEN d.user_decision = 'keep' THEN 'stale-keep' ELSE 'other' END AS kind
FROM v_filters f LEFT JOIN v_latest d ON d.sender_key = lower(f.from_addr)"""
ctes.CTES["v_create_in"] = """SELECT decision AS action, from_addr AS sender, row_number() OVER (PARTITION BY decision ORDER BY from_addr) AS pos
FROM v_classed WHERE kind = 'legacy-noise'"""
ctes.CTES["v_creates"] = PACK.format(group="action", source="v_create_in", over=0, items=100000, pre="", post="")


@query(
    "u5_action_signature",
    f"SELECT filter_id, {SET.format('add_csv')} AS add_set, {SET.format('remove_csv')} AS remove_set FROM v_filters",
)
def u5(v):
    return fl.action_signature(v.filters).select("filter_id", texts("add_set", ","), texts("remove_set", ","))


@query("j7_classify_filters", "SELECT filter_id, from_addr, decision, kind FROM v_classed")
def j7(v):
    return fl.classify_filters(v.filters, v.decisions).select("filter_id", "from_addr", "decision", "kind")


def _created(live: DataFrame, planned: DataFrame, action: str) -> DataFrame:
    """Live filters plus the planned ones of one action, as if these had been created."""
    made = planned.filter(F.col("action") == action).select(
        F.concat(F.lit("new-"), "action", F.lit("-"), "batch_no").alias("filter_id"),
        F.lit(None).cast("string").alias("from_addr"),
        "query",
        "add_labels",
        F.reverse("remove_labels").alias("remove_labels"),
    )
    return live.unionByName(made)


@query("s26_consolidation", "SELECT action, batch_no, senders, query FROM v_creates")
def s26(v):
    return fl.consolidation_plan(v.filters, v.decisions)["creates"].select(
        "action", F.col("batch_no").cast("int"), texts("senders", ","), "query"
    )


@query("j8_missing_filters", "SELECT action, batch_no, query FROM v_creates WHERE action <> 'unsubscribe'")
def j8(v):
    planned = fl.consolidation_plan(v.filters, v.decisions)["planned"]
    return fl.missing_filters(planned, _created(v.filters, planned, "unsubscribe")).select(
        "action", F.col("batch_no").cast("int"), "query"
    )


@query(
    "g20_migration_summary",
    """SELECT existing, created, deleted, deleted - created AS slots_freed, 1000 - (existing - stale) AS headroom, created > 1000 - (existing - stale) AS over_limit FROM
       (SELECT count(*) AS existing, count(*) FILTER (WHERE kind = 'stale-keep') AS stale, count(*) FILTER (WHERE kind <> 'other') AS deleted,
         (SELECT count(*) FROM v_creates) AS created FROM v_classed)""",
)
def g20(v):
    return fl.migration_summary(fl.consolidation_plan(v.filters, v.decisions))


@query(
    "j18_remaining_targets",
    """SELECT filter_id AS target, kind FROM v_classed WHERE kind = 'stale-keep' UNION ALL SELECT query, action FROM v_creates WHERE action = 'unsubscribe'""",
)
def j18(v):
    left = fl.remaining_targets(*_later(v))
    deletes = left["deletes"].select(F.col("filter_id").alias("target"), "kind")
    return deletes.unionByName(left["creates"].select(F.col("query").alias("target"), F.col("action").alias("kind")))


def _later(v: Views):
    """A frozen plan and the live filters after part of it was done."""
    plan = fl.consolidation_plan(v.filters, v.decisions)
    gone = plan["deletes"].filter("kind = 'legacy-noise'").select("filter_id")
    live = _created(v.filters.join(gone, "filter_id", "left_anti"), plan["planned"], "filter")
    return plan, live


@query(
    "s27_reconcile",
    """SELECT d AS remaining_deletes, c AS remaining_creates, d = 0 AND c = 0 AS satisfied FROM (SELECT
       (SELECT count(*) FROM v_classed WHERE kind = 'stale-keep') AS d, (SELECT count(*) FROM v_creates WHERE action = 'unsubscribe') AS c)""",
)
def s27(v):
    return fl.reconcile(*_later(v))


@query(
    "s35_covered_by_rule",
    """SELECT sender_key AS sender_email FROM v_latest WHERE user_decision = 'filter' AND log_seq % 2 = 1 AND log_seq % 3 <> 0""",
)
def s35(v):
    """One mailbox rule per decided sender; some are disabled or have a further condition."""
    latest = dc.latest_decisions(v.decisions)
    seq = F.col("log_seq")
    rules = latest.select(
        (seq % 2 == 1).alias("is_enabled"),
        F.array(F.upper("sender_key")).alias("sender_contains"),
        F.when(F.col("user_decision") == "filter", "archive").otherwise("other").alias("move_to_folder"),
        F.array(F.lit("_noise")).alias("assign_categories"),
        F.create_map(
            F.lit("hasAttachments"), F.when(seq % 3 == 0, "true").otherwise("false"), F.lit("subjectContains"), F.lit("[]")
        ).alias("other_conditions"),
    )
    senders = latest.select(F.col("sender_key").alias("sender_email"))
    return noise.covered_by_rule(rules, senders, "archive").select("sender_email")


# --- manifests --------------------------------------------------------------------------


def manifest(v: Views) -> DataFrame:
    """One batch per sender type, with the latest decisions and some steps done."""
    n = F.col("email_count")
    decided = dc.latest_decisions(v.decisions).select(
        F.col("sender_key").alias("sender_email"),
        F.col("reviewed_type").alias("reviewed_sender_type"),
        "user_decision",
        "messages_archived",
    )
    early = F.when(n % 4 == 0, "done").otherwise("pending")
    state = scored_state(v).drop("reviewed_sender_type", "user_decision")
    return state.join(decided, "sender_email").select(
        F.lit("r1").alias("run_id"),
        F.concat(F.lit("b-"), "sender_type").alias("batch_id"),
        F.lit("prepared").alias("status"),
        "sender_email",
        "sender_name",
        "email_count",
        "unread_ratio",
        "last_email_date",
        F.col("sender_type").alias("presented_sender_type"),
        "reviewed_sender_type",
        F.col("recommended_action").alias("system_recommendation"),
        "user_decision",
        (F.col("user_decision") == "filter").alias("filter_applied"),
        early.alias("filter_status"),
        early.alias("archive_status"),
        early.alias("log_status"),
        F.lit("pending").alias("state_status"),
        F.when(n % 3 == 0, "done").otherwise("pending").alias("sheet_status"),
        "messages_archived",
    )


@query(
    "g12_batch_summary",
    """SELECT run_id, batch_id, count(*) AS sender_count, CAST(sum(email_count) AS BIGINT) AS total_email_count, round(avg(unread_ratio), 6) AS average_unread_ratio
       FROM v_manifest GROUP BY 1, 2""",
)
def g12(v):
    return review.batch_summary(manifest(v)).withColumn("average_unread_ratio", F.round("average_unread_ratio", 6))


@query(
    "g11_batch_dashboard",
    """SELECT run_id, batch_id, count(*) AS total_senders, count(*) FILTER (WHERE sheet_status = 'done') AS processed,
       CAST(sum(messages_archived) AS BIGINT) AS emails_cleared, count(*) FILTER (WHERE user_decision = 'unsubscribe') AS unsubscribed,
       count(*) FILTER (WHERE filter_applied) AS filters_created, count(*) FILTER (WHERE sheet_status <> 'done') AS remaining FROM v_manifest GROUP BY 1, 2""",
)
def g11(v):
    return review.batch_dashboard(manifest(v))


@query(
    "s20_pending_steps",
    """SELECT run_id, batch_id, sender_email, step_no, step, CASE WHEN step = 'filter_status' OR (step = 'archive_status' AND user_decision = 'keep') THEN 'skipped' ELSE 'done' END AS outcome FROM
       (SELECT *, 0 AS step_no, 'filter_status' AS step, filter_status AS st FROM v_manifest UNION ALL SELECT *, 1, 'archive_status', archive_status FROM v_manifest
        UNION ALL SELECT *, 2, 'log_status', log_status FROM v_manifest UNION ALL SELECT *, 3, 'state_status', state_status FROM v_manifest
        UNION ALL SELECT *, 4, 'sheet_status', sheet_status FROM v_manifest) WHERE st = 'pending'""",
)
def s20(v):
    return review.pending_steps(manifest(v))


@query(
    "s19_decision_entries",
    f"""SELECT m.run_id, m.batch_id, m.sender_email, m.presented_sender_type AS presented_type, m.reviewed_sender_type AS reviewed_type,
        CASE WHEN m.reviewed_sender_type IS NULL THEN 'none' WHEN m.reviewed_sender_type <> m.presented_sender_type THEN 'corrected' ELSE 'confirmed' END AS feedback,
        m.user_decision, TIMESTAMP '{NOW}' AS decided_at, CASE WHEN m.user_decision = 'keep' THEN '' ELSE concat_ws(',', CASE WHEN m.filter_applied THEN 'filter' END,
          CASE WHEN m.messages_archived > 0 THEN 'archive' END) END AS actions_taken
        FROM v_manifest m WHERE NOT EXISTS (SELECT 1 FROM v_manifest d WHERE d.sender_email = m.sender_email AND d.batch_id = m.batch_id AND d.log_status = 'done')""",
)
def s19(v):
    m = manifest(v)
    log = m.filter("log_status = 'done'").select("run_id", "batch_id", F.upper("sender_email").alias("sender_email"))
    return review.decision_entries(m, log, NOW).select(
        "run_id",
        "batch_id",
        "sender_email",
        "presented_type",
        "reviewed_type",
        "feedback",
        "user_decision",
        "decided_at",
        texts("actions_taken", ","),
    )


@query(
    "j10_apply_review",
    f"""SELECT s.sender_email, coalesce(m.reviewed_sender_type, s.sender_type) AS sender_type, m.reviewed_sender_type AS reviewed_sender_type,
        CASE WHEN m.reviewed_sender_type IS NOT NULL THEN 'user' ELSE s.sender_type_source END AS sender_type_source,
        CASE WHEN m.reviewed_sender_type IS NULL THEN round(s.sender_type_confidence, 6) END AS sender_type_confidence,
        CASE WHEN m.sender_email IS NOT NULL THEN TIMESTAMP '{NOW}' END AS processed_at,
        CASE WHEN m.reviewed_sender_type IS NOT NULL THEN TIMESTAMP '{NOW}' END AS reviewed_at
        FROM v_state s LEFT JOIN (SELECT * FROM v_manifest WHERE user_decision <> 'keep') m USING (sender_email)""",
)
def j10(v):
    done = manifest(v).filter("user_decision <> 'keep'")
    return apply_review(scored_state(v), done, NOW).select(
        "sender_email",
        "sender_type",
        "reviewed_sender_type",
        "sender_type_source",
        F.round("sender_type_confidence", 6).alias("sender_type_confidence"),
        "processed_at",
        "reviewed_at",
    )


@query(
    "s18_reviewed_types",
    f"""SELECT s.sender_email, coalesce(m.reviewed_sender_type, s.sender_type) AS sender_type,
        CASE WHEN m.reviewed_sender_type IS NOT NULL THEN TIMESTAMP '{NOW}' END AS reviewed_at
        FROM v_state s LEFT JOIN v_manifest m USING (sender_email)""",
)
def s18(v):
    return apply_review(scored_state(v), manifest(v), NOW).select("sender_email", "sender_type", "reviewed_at")


@query(
    "j11_update_audit",
    f"""SELECT s.sender_email, coalesce(m.user_decision, '') AS user_decision, coalesce(m.reviewed_sender_type, m.presented_sender_type, s.sender_type) AS sender_type,
        CASE WHEN m.sender_email IS NOT NULL THEN '{NOW[:10]}' ELSE '' END AS processed
        FROM v_state s LEFT JOIN (SELECT * FROM v_manifest WHERE user_decision <> 'keep') m USING (sender_email)""",
)
def j11(v):
    done = manifest(v).filter("user_decision <> 'keep'")
    return review.update_audit(review.audit_rows(scored_state(v)), done, NOW).select(
        "sender_email", "user_decision", "sender_type", "processed"
    )


@query(
    "j19_validate_manifest",
    """SELECT sender_email, 'state' AS reason FROM v_manifest WHERE user_decision = 'keep' UNION ALL
       SELECT sender_email, 'audit' FROM v_manifest WHERE user_decision = 'filter'""",
)
def j19(v):
    m = manifest(v)
    state = m.filter("user_decision <> 'keep'").select("sender_email")
    audit = m.filter("user_decision <> 'filter'").select(F.upper("sender_email").alias("sender_email"))
    return review.validate_manifest(m, state, audit)


@query(
    "a16_brief_lines",
    f"""SELECT * FROM (WITH m AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY email_count DESC, sender_email) AS rn FROM v_manifest),
       b AS (SELECT run_id, batch_id, count(*) AS n, sum(email_count) AS mails, avg(unread_ratio) AS ratio FROM m GROUP BY 1, 2)
       SELECT batch_id, 0 AS section, unnest([concat('# Batch Brief: ', batch_id), '', concat('**Run ID:** ', run_id), concat('**Batch ID:** ', batch_id),
         '**Status:** prepared', '**Created:** {NOW}', '', '## Batch Info', '', '**Batch type:** x', '**Grouping reason:** by type',
         '**Presented recommendation:** keep', '', '## Summary', '', concat('- **Sender count:** ', format('{{:,}}', n)),
         concat('- **Total emails:** ', format('{{:,}}', CAST(mails AS BIGINT))),
         concat('- **Average unread ratio:** ', CAST(floor(ratio * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT), '%'), '', '## Senders', '']) AS line FROM b
       UNION ALL SELECT batch_id, 1, concat(rn, '. **', sender_email, '** (', sender_name, ') — ', format('{{:,}}', email_count), ' emails, ',
        CAST(floor(unread_ratio * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT), '% unread — decision: **', user_decision, '**') FROM m
       UNION ALL SELECT batch_id, 2, unnest(['', '## Type Corrections', '']) FROM (SELECT DISTINCT batch_id FROM m WHERE reviewed_sender_type <> presented_sender_type)
       UNION ALL SELECT batch_id, 4, unnest(['', '> **Safety note:** If this brief conflicts with the JSON manifest, the manifest wins.', '']) FROM b
       UNION ALL SELECT batch_id, 3, concat('- **', sender_email, '**: ', presented_sender_type, ' → ', reviewed_sender_type) FROM m
       WHERE reviewed_sender_type <> presented_sender_type)""",
)
def a16_brief(v):
    """All lines of all briefs."""
    from mailsift.ranking import number_by_order

    m = number_by_order(manifest(v), ["batch_id"], [F.desc("email_count"), F.col("sender_email")], "position")
    headers = m.select("run_id", "batch_id", "status").distinct().select(
        "*",
        F.lit("x").alias("batch_type"),
        F.lit("by type").alias("grouping_reason"),
        F.lit("keep").alias("presented_recommendation"),
        F.lit(NOW).alias("created_at"),
    )
    return reports.brief_lines(m, headers).select("batch_id", "section", "line")


# --- triage -----------------------------------------------------------------------------


def triage(v: Views) -> DataFrame:
    return review.triage_queue(v.messages)


def label_names(v: Views) -> DataFrame:
    """Names of the user labels that messages carry."""
    ids = v.messages.select(F.explode("labels").alias("label_id")).distinct().filter("label_id LIKE 'L%'")
    return ids.select("label_id", F.when(F.col("label_id") == "L0", "_hidden").otherwise(F.concat(F.lit("Topic "), "label_id")).alias("name"))


ctes.CTES["v_items"] = """
SELECT t.thread_id, t.message_id AS representative_id, c.n AS message_count, t.sender_email, t.subject, t.date_received,
  coalesce(CASE WHEN regexp_matches(t.label_csv, 'L[123]') THEN concat('Topic ', regexp_extract(t.label_csv, 'L[123]')) END, 'uncategorized') AS category
FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ingest_seq) AS rn FROM v_triage) t
JOIN (SELECT thread_id, count(*) AS n FROM v_triage GROUP BY 1) c USING (thread_id) WHERE t.rn = 1"""


@query("p7_triage_queue", "SELECT message_id FROM v_triage")
def p7(v):
    return triage(v).select("message_id")


@query("g6_triage_threads", "SELECT thread_id, representative_id, message_count FROM v_items")
def g6(v):
    return review.triage_threads(triage(v))


ITEM = "thread_id, representative_id, message_count, sender_email, subject, category"


@query("s28_triage_items", f"SELECT {ITEM} FROM v_items")
def s28(v):
    return review.triage_items(triage(v), label_names(v)).select(*ITEM.split(", "))


@query("o2_action_items", f"SELECT {ITEM} FROM v_items")
def o2(v):
    return review.order_action_items(review.triage_items(triage(v), label_names(v))).select(*ITEM.split(", "))


@query(
    "a16_action_lines",
    f"""SELECT section, category, thread_id, minor, line FROM (
       SELECT 0 AS section, '' AS category, '' AS thread_id, 0 AS minor, '# Action Pass Report — {AS_OF[:10]}' AS line
       UNION ALL SELECT 0, '', '', 1, ''
       UNION ALL SELECT 1, category, thread_id, 0, concat('- **From:** ', sender_email) FROM v_items
       UNION ALL SELECT 1, category, thread_id, 1, concat('  **Subject:** ', subject) FROM v_items
       UNION ALL SELECT 1, category, thread_id, 2, concat('  **Date:** ', strftime(date_received, '%Y-%m-%d %H:%M:%S'),
         rtrim(rtrim(strftime(date_received, '.%f'), '0'), '.')) FROM v_items
       UNION ALL SELECT 1, category, thread_id, 3, concat('  **Thread ID:** ', thread_id) FROM v_items
       UNION ALL SELECT 1, category, thread_id, 4, concat('  **Messages:** ', message_count) FROM v_items
       UNION ALL SELECT 1, category, thread_id, 5, concat('  **Representative Message ID:** ', representative_id) FROM v_items
       UNION ALL SELECT 1, category, thread_id, 6, '' FROM v_items
       UNION ALL SELECT DISTINCT 1, category, '', 0, concat('## ', category) FROM v_items
       UNION ALL SELECT DISTINCT 1, category, '', 1, '' FROM v_items)""",
)
def a16_action(v):
    lines = reports.action_lines(review.triage_items(triage(v), label_names(v)), AS_OF)
    return lines.select("section", "category", "thread_id", F.col("minor").cast("int"), "line")


def review_decisions(v: Views) -> DataFrame:
    """A decision for each triaged thread or one of its messages, and for all other threads."""
    choice = F.when(F.col("message_count") % 2 == 0, "star").otherwise("archive")
    known = review.triage_threads(triage(v))
    by_id = F.when(F.col("message_count") > 1, F.col("thread_id")).otherwise(F.col("representative_id"))
    return known.select(by_id.alias("review_id"), choice.alias("decision"))


@query(
    "j14_resolve_decisions",
    """SELECT CASE WHEN message_count > 1 THEN thread_id ELSE representative_id END AS review_id, CASE WHEN message_count % 2 = 0 THEN 'star' ELSE 'archive' END AS decision,
       thread_id, 'ok' AS outcome FROM v_items
       UNION ALL SELECT DISTINCT thread_id, 'star', CAST(NULL AS VARCHAR), 'unknown' FROM v_messages WHERE thread_id NOT IN (SELECT thread_id FROM v_triage)""",
)
def j14(v):
    other = v.flat.select("thread_id").distinct().join(triage(v).select("thread_id"), "thread_id", "left_anti")
    more = other.select(F.col("thread_id").alias("review_id"), F.lit("star").alias("decision"))
    return review.resolve_decisions(review_decisions(v).unionByName(more), triage(v))


@query(
    "g24_review_counts",
    "SELECT count(*) FILTER (WHERE message_count % 2 = 0) AS starred, count(*) FILTER (WHERE message_count % 2 = 1) AS archived FROM v_items",
)
def g24(v):
    return review.review_counts(review.resolve_decisions(review_decisions(v), triage(v)))


@query(
    "s29_finalize_plan",
    """SELECT decision, chunk_no, count(*) AS ids, string_agg(message_id, ',' ORDER BY ingest_seq) AS message_ids,
       CASE decision WHEN 'star' THEN 'STARRED' ELSE '' END AS add_labels, CASE decision WHEN 'star' THEN '_triage' ELSE 'INBOX,_triage' END AS remove_labels FROM
       (SELECT *, (row_number() OVER (PARTITION BY decision ORDER BY ingest_seq) - 1) // 1000 AS chunk_no FROM
         (SELECT t.message_id, t.ingest_seq, CASE WHEN i.message_count % 2 = 0 THEN 'star' ELSE 'archive' END AS decision
          FROM v_triage t JOIN v_items i USING (thread_id))) GROUP BY 1, 2""",
)
def s29(v):
    return review.finalize_plan(review_decisions(v), triage(v)).select(
        "decision", "chunk_no", "ids", texts("message_ids", ","), texts("add_labels", ","), texts("remove_labels", ",")
    )
