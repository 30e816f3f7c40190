"""Checked queries on threads: collapse, rules, classification, labels, digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.checks import ctes
from mailsift.checks.registry import query
from mailsift.checks.sender_queries import stats, texts
from mailsift.checks.views import AS_OF, SINCE, Views
from mailsift.functions import text as tx
from mailsift.operators import labels as lb
from mailsift.operators import noise, senders
from mailsift.operators import threads as th
from mailsift.plans import composed, reports
from mailsift.session import scratch_path
from mailsift.sources.readers import load_rules

CLASS = "thread_id, category, confidence, actionable, summary, classified_by, rule_name"


def thread_results(heads: DataFrame) -> DataFrame:
    """Stand-in model results for all subjects but one."""
    many = F.col("message_count")
    return heads.filter("subject <> 'Topic 0'").select(
        "thread_id",
        F.concat(F.lit("about "), F.lower("subject")).alias("category"),
        F.when(many > 4, 0.9).otherwise(0.7).alias("confidence"),
        (many > 3).alias("actionable"),
        F.concat(F.lit("On "), "subject").alias("summary"),
    )


def classified(v: Views) -> DataFrame:
    results = thread_results(th.thread_heads(v.mail))
    return composed.classify_with_results(v.mail, v.rules, results, AS_OF)


def label_ids(classifications: DataFrame) -> DataFrame:
    names = th.known_categories(classifications).filter("category <> 'uncategorized'").select(F.col("category").alias("name"))
    triage = classifications.sparkSession.range(1).select(F.lit("_triage").alias("name"))
    return names.unionByName(triage).select("name", F.concat(F.lit("Label_"), "name").alias("label_id"))


# --- collapse -------------------------------------------------------------------------


HEADS = "thread_id, sender_email, subject, first_date, last_date, message_count"


def _in_order(value: str, *order: str, by: str = ","):
    """Rows of a thread as one text, to compare with the oracle."""
    return F.array_join(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))["_v"], by)


@query(
    "g4_threads",
    """SELECT h.thread_id, h.sender_email, h.subject, h.first_date, h.last_date, h.message_count, p.participants,
       coalesce(c.content, '') AS content FROM v_heads h JOIN v_participants p USING (thread_id) JOIN v_parts c USING (thread_id)""",
)
def g4(v):
    """Heads, with the rows of participants and entries in their order."""
    people = th.thread_participants(v.mail).groupBy("thread_id").agg(
        _in_order("participant", "first_date", "first_seq").alias("participants")
    )
    pieces = th.thread_entries(v.mail, v.bodies).filter("content <> ''").groupBy("thread_id")
    contents = pieces.agg(_in_order("content", "position", by="\n\n").alias("content"))
    heads = th.collapse_threads(v.mail).drop("participants").join(people, "thread_id").join(contents, "thread_id", "left")
    return heads.select(*HEADS.split(", "), "participants", F.coalesce("content", F.lit("")).alias("content"))


@query("g4_thread_heads", f"SELECT {HEADS} FROM ({ctes.heads('v_messages')})")
def g4_heads(v):
    return th.thread_heads(v.messages).select(*HEADS.split(", "))


@query(
    "g4_participants",
    """SELECT thread_id, sender_email AS participant, min(date_received) AS first_date, count(*) AS messages FROM v_messages GROUP BY 1, 2""",
)
def g4_participants(v):
    return th.thread_participants(v.messages).drop("first_seq")


@query("g5_thread_messages", "SELECT thread_id, message_ids FROM v_parts")
def g5(v):
    ordered = _in_order("message_id", "position").alias("message_ids")
    return th.thread_messages(v.mail).groupBy("thread_id").agg(ordered)


@query(
    "o5_thread_order",
    """SELECT thread_id, string_agg(message_id, ',' ORDER BY date_received, ingest_seq) AS message_ids FROM v_messages GROUP BY 1""",
)
def o5(v):
    ordered = _in_order("message_id", "position").alias("message_ids")
    return th.thread_messages(v.messages).groupBy("thread_id").agg(ordered)


@query("n12_unique_content", f"SELECT message_id, {ctes.unique_content('body')} AS content FROM v_mail")
def n12(v):
    return v.bodies.select("message_id", tx.unique_content("body").alias("content"))


@query("n12_unique_documents", f"SELECT doc_id, {ctes.unique_content('text')} AS content FROM documents")
def n12_documents(v):
    return v.table("documents").select("doc_id", tx.unique_content("text").alias("content"))


@query(
    "n11_strip_html",
    """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'),
       '[ \\t]{2,}', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS body FROM pages""",
)
def n11(v):
    return v.table("pages").select("page_id", tx.strip_html("html").alias("body"))


@query("x13_preview", "SELECT doc_id, substr(text, 1, 500) AS preview FROM documents")
def x13(v):
    return v.table("documents").select("doc_id", tx.preview("text").alias("preview"))


@query(
    "j3_with_bodies",
    """SELECT m.message_id, CASE WHEN m.subject <> 'Topic 1' THEN m.body ELSE '' END AS body FROM v_mail m""",
)
def j3(v):
    known = v.flat_mail.filter("subject <> 'Topic 1'").select("message_id", "body")
    return th.with_bodies(v.mail, known).select("message_id", "body")


# --- rules and classification -----------------------------------------------------------


@query(
    "j2_match_rules",
    """SELECT h.thread_id, s.rule_key IS NOT NULL AS sender_matched, s.category AS sender_category,
       d.rule_key IS NOT NULL AS domain_matched, d.category AS domain_category FROM v_heads h
       LEFT JOIN v_rules s ON s.kind = 'sender' AND s.rule_key = lower(trim(h.sender_email))
       LEFT JOIN v_rules d ON d.kind = 'domain' AND d.rule_key = split_part(lower(trim(h.sender_email)), '@', 2)""",
)
def j2(v):
    return th.match_rules(th.thread_heads(v.mail), v.rules).select(
        "thread_id", "sender_matched", "sender_category", "domain_matched", "domain_category"
    )


@query("s9_classify_rules", f"SELECT {CLASS} FROM v_by_rule")
def s9(v):
    return th.classify_rules(th.thread_heads(v.mail), v.rules, AS_OF)


@query("j4_unmatched_messages", "SELECT message_id, thread_id FROM v_mail WHERE thread_id NOT IN (SELECT thread_id FROM v_by_rule)")
def j4(v):
    rules = th.classify_rules(th.thread_heads(v.mail), v.rules, AS_OF)
    return th.unmatched_messages(v.mail, rules).select("message_id", "thread_id")


@query("s13_thread_results", f"SELECT {CLASS} FROM v_by_model")
def s13(v):
    heads = th.thread_heads(v.mail)
    rest = th.unmatched_threads(heads, th.classify_rules(heads, v.rules, AS_OF))
    return th.apply_thread_results(rest, thread_results(heads), AS_OF)


@query("u1_all_classifications", f"SELECT {CLASS} FROM v_classified")
def u1(v):
    return classified(v)


@query(
    "s11_run_classification",
    """SELECT count(*) AS threads, count(*) FILTER (WHERE classified_by = 'rule') AS by_rule,
       count(*) FILTER (WHERE classified_by = 'llm') AS by_model FROM v_classified""",
)
def s11(v):
    return composed.classification_counts(classified(v))


@query("g17_known_categories", "SELECT DISTINCT category FROM v_classified")
def g17(v):
    return th.known_categories(classified(v))


@query("g8_category_counts", "SELECT category, count(*) AS threads FROM v_classified GROUP BY 1")
def g8(v):
    return composed.category_counts(classified(v))


@query(
    "s10_rules_template",
    """SELECT 'sender' AS kind, trim(sender_email) AS rule_key, CAST(NULL AS VARCHAR) AS category FROM v_stats
       UNION SELECT 'domain', split_part(lower(trim(sender_email)), '@', 2), NULL FROM v_stats""",
)
def s10(v):
    return th.rules_template(stats(v))


@query(
    "a11_load_rules",
    """SELECT kind, rule_key, category FROM (SELECT 'sender' AS kind, lower(sender_email) AS rule_key, category,
       row_number() OVER (PARTITION BY lower(sender_email) ORDER BY ingest_seq DESC) AS rn FROM v_messages) WHERE rn = 1""",
)
def a11(v):
    """A rules file of two maps, in which keys differ by case; of equal keys the last wins."""
    path = scratch_path(v.spark, "rules")
    listed = v.flat.groupBy("sender_email").agg(F.max_by("category", "ingest_seq").alias("category"), F.max("ingest_seq").alias("s"))
    entry = F.struct(F.col("sender_email").alias("key"), F.col("category").alias("value"))
    rules = F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", entry.alias("e"))))["e"])
    text = F.to_json(F.struct(F.create_map().cast("map<string,string>").alias("domainRules"), rules.alias("senderRules")))
    listed.agg(text.alias("value")).write.text(path)
    return load_rules(v.spark, path)


@query(
    "w11_taxonomy_sample",
    """SELECT h.thread_id, concat('Subject: ', h.subject, chr(10), 'From: ', h.sender_email, chr(10), coalesce(c.content, '')) AS summary
       FROM v_heads h JOIN v_parts c USING (thread_id) ORDER BY md5(h.thread_id), h.thread_id LIMIT 1000""",
)
def w11(v):
    return th.taxonomy_sample(th.thread_heads(v.mail), th.thread_entries(v.mail, v.bodies)).select("thread_id", "summary")


# --- labels -----------------------------------------------------------------------------


@query(
    "j6_label_targets",
    """SELECT m.message_id, c.thread_id, c.category, l.label_id, c.actionable FROM v_classified c JOIN v_label_ids l ON l.name = c.category
       JOIN v_mail m USING (thread_id)""",
)
def j6(v):
    c = classified(v)
    return lb.label_targets(c, v.mail, label_ids(c)).select("message_id", "thread_id", "category", "label_id", "actionable")


@query(
    "j6_label_failures",
    """SELECT thread_id, category, 'no label' AS reason FROM v_classified WHERE category = 'uncategorized'""",
)
def j6_failures(v):
    c = classified(v)
    return lb.label_failures(c, v.mail, label_ids(c))


PLAN = """SELECT label_id, action, chunk_no, ids, message_ids, CASE action WHEN 'triage' THEN concat(label_id, ',Label__triage') ELSE label_id END AS add_labels,
 CASE action WHEN 'archive' THEN 'INBOX' ELSE '' END AS remove_labels FROM
 (SELECT label_id, action, (rn - 1) // 50 AS chunk_no, count(*) AS ids, string_agg(message_id, ',' ORDER BY ingest_seq) AS message_ids FROM
  (SELECT l.label_id, CASE WHEN c.actionable THEN 'triage' ELSE 'archive' END AS action, m.message_id, m.ingest_seq,
    row_number() OVER (PARTITION BY l.label_id, c.actionable ORDER BY m.ingest_seq) AS rn
   FROM v_classified c JOIN v_label_ids l ON l.name = c.category JOIN v_mail m USING (thread_id)) GROUP BY 1, 2, 3)"""


def label_plan(v: Views, size: int = 50) -> DataFrame:
    c = classified(v)
    return lb.label_plan(c, v.mail, label_ids(c), size)


@query("s22_label_plan", PLAN)
def s22(v):
    return label_plan(v).select(
        "label_id",
        "action",
        "chunk_no",
        "ids",
        texts("message_ids", ","),
        texts("add_labels", ","),
        texts("remove_labels", ","),
    )


@query(
    "g9_apply_summary",
    """SELECT count(*) AS applied, count(*) FILTER (WHERE NOT c.actionable) AS archived, count(*) FILTER (WHERE c.actionable) AS triaged,
       (SELECT count(*) FROM v_classified WHERE category = 'uncategorized') AS failures
       FROM v_classified c JOIN v_mail m USING (thread_id) WHERE c.category <> 'uncategorized'""",
)
def g9(v):
    c = classified(v)
    return lb.apply_summary(lb.label_plan(c, v.mail, label_ids(c)), lb.label_failures(c, v.mail, label_ids(c)))


@query(
    "u6_missing_labels",
    """SELECT DISTINCT category AS name FROM v_classified WHERE category NOT IN (SELECT category FROM v_rules WHERE category IS NOT NULL)""",
)
def u6(v):
    required = classified(v).select(F.col("category").alias("name"))
    return lb.missing_labels(required, v.rules.select(F.col("category").alias("name")))


@query(
    "w7_chunks",
    """SELECT category, message_id, (row_number() OVER (PARTITION BY category ORDER BY ingest_seq) - 1) // 500 AS chunk_no FROM v_messages""",
)
def w7(v):
    from mailsift.ranking import chunk

    return chunk(v.flat.select("category", "message_id", "ingest_seq"), ["category"], "ingest_seq", 500).select(
        "category", "message_id", "chunk_no"
    )


# --- digest -----------------------------------------------------------------------------

# The digest covers mail in scope since a date; its threads are those of that mail only.
DIGEST = {
    "v_new": f"SELECT * FROM v_messages WHERE date_received >= TIMESTAMP '{SINCE}' AND NOT list_has_any(string_split(label_csv, ','), ['SPAM','TRASH','DRAFT','SENT'])",
    "v_new_heads": ctes.heads("v_new"),
    "v_new_rules": """SELECT * FROM (VALUES ('domain','chase.com','finance'), ('domain','gmail.com','personal'), ('domain','salesforce.com',NULL)) AS r(kind, rule_key, category)""",
}
ctes.CTES.update(DIGEST)
ctes.CTES["v_digest"] = """
SELECT h.thread_id, h.sender_email, h.subject, h.first_seq, coalesce(d.category, CASE WHEN h.message_count > 1 THEN 'conversation' END, 'uncategorized') AS category,
  d.category IS NOT NULL OR (h.message_count > 1) AS actionable, d.category IS NOT NULL AS by_rule
FROM v_new_heads h LEFT JOIN v_new_rules d ON d.rule_key = split_part(lower(h.sender_email), '@', 2)"""


def digest(v: Views) -> dict[str, DataFrame]:
    rules = v.sql(DIGEST["v_new_rules"])
    heads = th.thread_heads(noise.new_since(v.messages, F.lit(SINCE).cast("timestamp_ntz")))
    results = heads.filter("message_count > 1").select(
        "thread_id",
        F.lit("conversation").alias("category"),
        F.lit(0.8).alias("confidence"),
        F.lit(True).alias("actionable"),
        F.lit("").alias("summary"),
    )
    return composed.digest(v.messages, rules, results, SINCE, AS_OF)


@query("s30_digest", "SELECT thread_id, sender_email, subject, category, actionable FROM v_digest")
def s30(v):
    return digest(v)["classifications"].select("thread_id", "sender_email", "subject", "category", "actionable")


@query(
    "g7_digest_counts",
    """SELECT (SELECT count(*) FROM v_new) AS total_new, count(*) AS categorized, count(*) FILTER (WHERE actionable) AS actionable FROM v_digest""",
)
def g7(v):
    return digest(v)["counts"]


@query(
    "a16_digest_lines",
    """SELECT section, line FROM (
       SELECT 0 AS section, unnest(['# Daily Digest — 2024-02-15', '', concat('**Total new messages:** ', (SELECT count(*) FROM v_new)),
         concat('**Auto-categorized threads:** ', (SELECT count(*) FROM v_digest)),
         concat('**Actionable threads:** ', (SELECT count(*) FROM v_digest WHERE actionable)), '', '## Categories']) AS line
       UNION ALL SELECT 1, concat('- ', category, ': ', count(*), ' thread', CASE WHEN count(*) = 1 THEN '' ELSE 's' END) FROM v_digest GROUP BY category
       UNION ALL SELECT 2, unnest(['', '## Actionable Items'])
       UNION ALL SELECT 3, concat('- **', sender_email, '** — ', subject) FROM v_digest WHERE actionable
       UNION ALL SELECT 4, '')""",
)
def a16_digest(v):
    return reports.digest_lines(digest(v), AS_OF).select("section", "line")


# --- predicates over messages -----------------------------------------------------------


@query(
    "p1_in_scope",
    "SELECT message_id FROM v_messages WHERE NOT list_has_any(string_split(label_csv, ','), ['SPAM','TRASH','DRAFT','SENT'])",
)
def p1(v):
    return noise.in_scope(v.messages).select("message_id")


@query("p3_new_since", "SELECT message_id FROM v_new")
def p3(v):
    return noise.new_since(v.messages, F.lit(SINCE).cast("timestamp_ntz")).select("message_id")


@query("p5_messages_from", "SELECT message_id FROM v_messages WHERE lower(sender_email) = 'noreply@acme.com'")
def p5(v):
    return noise.messages_from(v.messages, "NoReply@acme.com").select("message_id")


@query(
    "p6_extraction_messages",
    f"""SELECT message_id FROM v_messages WHERE lower(sender_email) IN
        (SELECT sender_email FROM v_heuristic WHERE {ctes.extraction('heuristic_type')})""",
)
def p6(v):
    from mailsift.operators.scoring import classify_heuristic, score_extraction

    typed = classify_heuristic(senders.sender_stats(v.messages)).withColumn("sender_type", F.col("heuristic_type"))
    return noise.extraction_messages(v.messages, score_extraction(typed)).select("message_id")
