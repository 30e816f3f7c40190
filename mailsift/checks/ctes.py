"""Shared CTEs of the oracle SQL, written for DuckDB independently of the Spark code."""

from __future__ import annotations

import re

from mailsift.checks import views

# Fixed values used by the oracle.
MARKETING = (
    "(mailchimp\\.com|sendgrid\\.net|constantcontact\\.com|klaviyo\\.com|campaignmonitor\\.com|marketo\\.net"
    "|salesforce\\.com|hubspot\\.com|mailgun\\.org|amazonses\\.com|postmarkapp\\.com|sparkpostmail\\.com)"
)
FREEMAIL = (
    "'gmail.com','yahoo.com','hotmail.com','outlook.com','icloud.com','aol.com','protonmail.com','proton.me',"
    "'mail.com','zoho.com','yandex.com','gmx.com','fastmail.com','tutanota.com','hey.com','live.com','msn.com',"
    "'me.com','mac.com','yahoo.co.uk'"
)
TEMPLATE = (
    "(your\\s+(order|receipt|invoice|statement|subscription|account)|order\\s*#"
    "|shipping\\s+(update|confirmation|notification)"
    "|(weekly|daily|monthly)\\s+(digest|report|summary|update|roundup))"
)


def stats(source: str) -> str:
    """Sender statistics over a message CTE."""
    return f"""
SELECT b.*, n.sender_name, c.category, t.thread_count, s.sample_subjects FROM
 (SELECT lower(sender_email) AS sender_email, count(*) AS email_count,
         count(*) FILTER (WHERE is_unread) / count(*) AS unread_ratio,
         count(*) FILTER (WHERE list_contains(string_split(label_csv, ','), 'STARRED')) AS starred_count,
         count(*) FILTER (WHERE list_contains(string_split(label_csv, ','), 'IMPORTANT')) AS important_count,
         min(date_received) AS first_email_date, max(date_received) AS last_email_date, min(ingest_seq) AS first_seq
  FROM {source} GROUP BY 1) b
 JOIN (SELECT k AS sender_email, coalesce(max(CASE WHEN rn = 1 AND sender_name <> '' THEN sender_name END), '') AS sender_name FROM
        (SELECT lower(sender_email) AS k, sender_name, row_number() OVER (PARTITION BY lower(sender_email)
           ORDER BY sender_name = '', date_received DESC, ingest_seq DESC) AS rn FROM {source}) GROUP BY 1) n USING (sender_email)
 JOIN (SELECT k AS sender_email, category FROM
        (SELECT lower(sender_email) AS k, category, row_number() OVER (PARTITION BY lower(sender_email)
           ORDER BY count(*) DESC, min(ingest_seq)) AS rn FROM {source} GROUP BY 1, 2) WHERE rn = 1) c USING (sender_email)
 JOIN (SELECT lower(sender_email) AS sender_email, count(DISTINCT thread_id) AS thread_count FROM {source} GROUP BY 1) t USING (sender_email)
 JOIN (SELECT k AS sender_email, list(subject ORDER BY rn) AS sample_subjects FROM
        (SELECT lower(sender_email) AS k, subject, row_number() OVER (PARTITION BY lower(sender_email)
           ORDER BY max(date_received) DESC, min(ingest_seq)) AS rn FROM {source} GROUP BY 1, 2) WHERE rn <= 5 GROUP BY 1) s USING (sender_email)
"""


def heads(source: str) -> str:
    """Thread heads over a message CTE."""
    return f"""
SELECT f.thread_id, f.sender_email, f.subject, f.date_received AS first_date, a.last_date, a.message_count, a.first_seq FROM
 (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY date_received, ingest_seq) AS rn FROM {source}) f
 JOIN (SELECT thread_id, max(date_received) AS last_date, count(*) AS message_count, min(ingest_seq) AS first_seq
       FROM {source} GROUP BY 1) a USING (thread_id) WHERE f.rn = 1
"""


def heuristic(source: str) -> str:
    """Heuristic sender type over a statistics CTE."""
    return f"""
SELECT *, CASE WHEN hard THEN 'automated' WHEN best < CAST(0.6 AS DOUBLE) THEN 'unknown' WHEN v_a = best THEN 'automated'
               WHEN v_n = best THEN 'newsletter' WHEN v_c = best THEN 'company' ELSE 'human' END AS heuristic_type,
       CASE WHEN hard THEN CAST(0.95 AS DOUBLE) ELSE least(best, CAST(1 AS DOUBLE)) END AS heuristic_confidence
FROM (SELECT *, greatest(v_h, v_c, v_n, v_a) AS best FROM (SELECT *,
  lp IN ('noreply','no-reply','notifications','mailer','digest') AS hard,
  CASE WHEN dom IN ({FREEMAIL}) THEN CAST(0.7 AS DOUBLE) ELSE 0 END
   + CASE WHEN nm <> '' AND regexp_matches(nm, '^[A-Z][a-z]{{1,20}}(\\s[A-Z][a-z]{{1,20}}){{1,2}}$') THEN CAST(0.4 AS DOUBLE) ELSE 0 END
   + CASE WHEN ratio >= CAST(0.7 AS DOUBLE) THEN CAST(0.3 AS DOUBLE) ELSE 0 END + CAST(0.3 AS DOUBLE) * chat AS v_h,
  CASE WHEN nm <> '' AND NOT news AND regexp_matches(nm, '(?i)\\b(team|inc|llc|corp)\\b') THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS v_c,
  CASE WHEN news THEN CAST(0.5 AS DOUBLE) ELSE 0 END + CASE WHEN ratio <= CAST(0.1 AS DOUBLE) THEN CAST(0.2 AS DOUBLE) ELSE 0 END
   + CAST(0.5 AS DOUBLE) * tmpl AS v_n,
  CASE WHEN lp IN ('support','billing','info','team','hello','updates','news','marketing','contact','admin','sales') THEN CAST(0.3 AS DOUBLE) ELSE 0 END
   + CASE WHEN nm = '' OR lower(nm) = lp THEN CAST(0.3 AS DOUBLE) ELSE 0 END
   + CASE WHEN ratio <= CAST(0.1 AS DOUBLE) THEN CAST(0.2 AS DOUBLE) ELSE 0 END + CAST(0.2 AS DOUBLE) * tmpl AS v_a
 FROM (SELECT *, split_part(lower(sender_email), '@', 1) AS lp, lower(substr(sender_email, strpos(sender_email, '@') + 1)) AS dom,
   trim(sender_name) AS nm, thread_count / email_count AS ratio,
   trim(sender_name) <> '' AND regexp_matches(trim(sender_name), '(?i)\\b(newsletter|updates|digest|news|weekly|daily|monthly)\\b') AS news,
   len(list_filter(sample_subjects, lambda s: regexp_matches(s, '(?i){TEMPLATE}'))) / len(sample_subjects) AS tmpl,
   len(list_filter(sample_subjects, lambda s: regexp_matches(s, '^(Re|Fwd):\\s'))) / len(sample_subjects) AS chat
  FROM {source})))
"""


def extraction(kind: str = "sender_type") -> str:
    d = "CAST({} AS DOUBLE)".format
    return f"""(email_count >= 3 AND {d('0.4')} * least((thread_count / email_count) / {d('0.5')}, 1)
   + {d('0.3')} * (1 - unread_ratio)
   + {d('0.2')} * least(((starred_count + important_count) / email_count) / {d('0.1')}, 1)
   + {d('0.1')} * (CASE WHEN {kind} = 'human' THEN {d('0.5')} ELSE 0 END + CASE WHEN category = 'primary' THEN {d('0.3')} ELSE 0 END
     + {d('0.2')}) >= {d('0.5')})"""


def scored(source: str, dialect: str = "gmail", kind: str = "sender_type") -> str:
    """Noise score over a statistics CTE."""
    d = "CAST({} AS DOUBLE)".format
    marketing, soft = MARKETING, "(salesforce\\.com|hubspot\\.com)"
    if dialect == "o365":
        marketing = marketing.replace("|salesforce\\.com|hubspot\\.com", "")
    type_noise = f"""CASE {kind} WHEN 'human' THEN 0 WHEN 'company' THEN {d('0.5')} WHEN 'newsletter' THEN {d('0.8')}
      WHEN 'automated' THEN {d('0.9')} ELSE {d('0.5')} END"""
    if dialect == "o365":
        type_noise = f"CASE WHEN regexp_matches(lower(sender_email), '^[^@]*@(.*\\.)?{soft}$') THEN greatest({type_noise}, {d('0.6')}) ELSE {type_noise} END"
    return f"""
SELECT *, CASE WHEN override THEN 'definitely_noise' WHEN email_count <= 1 THEN 'probably_keep' WHEN score >= {d('0.7')} THEN 'definitely_noise'
   WHEN score >= {d('0.5')} THEN 'probably_noise' WHEN score >= {d('0.3')} THEN 'probably_keep' ELSE 'definitely_keep' END AS confidence_tier,
  CASE WHEN override THEN 'unsubscribe' WHEN email_count <= 1 THEN 'keep' WHEN score >= {d('0.7')} THEN 'unsubscribe'
   WHEN score >= {d('0.5')} THEN 'filter' ELSE 'keep' END AS recommended_action,
  NOT override AND email_count > 20 AND category = 'primary' AND unread_ratio > {d('0.8')} AS surprises_flag,
  CASE WHEN NOT override AND email_count > 1 THEN score END AS noise_score
FROM (SELECT *, split_part(lower(sender_email), '@', 1) IN ('noreply','no-reply','notifications')
   OR regexp_matches(lower(sender_email), '^[^@]*@(.*\\.)?{marketing}$') AS override,
  {d('0.3')} * unread_ratio
  + {d('0.2')} * CASE category WHEN 'promotions' THEN 1 WHEN 'social' THEN {d('0.8')} WHEN 'updates' THEN {d('0.6')} WHEN 'forums' THEN {d('0.5')}
      WHEN 'primary' THEN 0 ELSE {d('0.5')} END
  + {d('0.15')} * CASE WHEN last_email_date >= TIMESTAMP '{views.AS_OF}' - INTERVAL 90 DAY THEN 0
      WHEN last_email_date >= TIMESTAMP '{views.AS_OF}' - INTERVAL 365 DAY THEN {d('0.4')} ELSE {d('0.9')} END
  + {d('0.1')} * CASE WHEN thread_count > 10 THEN 0 WHEN thread_count > 3 THEN {d('0.3')} ELSE {d('0.8')} END
  + {d('0.25')} * ({type_noise}) AS score FROM {source})
"""


def enriched(source: str) -> str:
    """Typed senders over a heuristic CTE that also has stored review fields."""
    return f"""
SELECT e.*, {extraction()} AS extraction_candidate FROM (
 SELECT h.* EXCLUDE (sender_type, sender_type_confidence, sender_type_source),
  CASE WHEN by_user THEN coalesce(h.reviewed_sender_type, h.sender_type, 'unknown') WHEN heuristic_type <> 'unknown' THEN heuristic_type
       ELSE coalesce(r.result_type, 'unknown') END AS sender_type,
  CASE WHEN by_user THEN h.sender_type_confidence WHEN heuristic_type <> 'unknown' THEN heuristic_confidence
       ELSE coalesce(r.result_confidence, 0) END AS sender_type_confidence,
  CASE WHEN by_user THEN 'user' WHEN heuristic_type <> 'unknown' THEN 'heuristic' WHEN r.email IS NOT NULL THEN 'llm' END AS sender_type_source
 FROM (SELECT *, coalesce(sender_type_source = 'user', false) OR reviewed_sender_type IS NOT NULL AS by_user FROM {source}) h
 LEFT JOIN v_sender_results r ON r.email = h.sender_email) e
"""


NO_REVIEW = (
    "CAST(NULL AS VARCHAR) AS sender_type, CAST(NULL AS DOUBLE) AS sender_type_confidence, "
    "CAST(NULL AS VARCHAR) AS sender_type_source, CAST(NULL AS VARCHAR) AS reviewed_sender_type"
)

MARKER = "^On .+ wrote:\\s*$|^From: .*$|^-{6}.*$"


def unique_content(body: str) -> str:
    """New content of a body, line by line."""
    lines = f"string_split({body}, chr(10))"
    first = f"list_position(list_transform({lines}, lambda l: regexp_matches(l, '{MARKER}')), true)"
    own = f"CASE WHEN coalesce({first}, 0) = 0 THEN {lines} ELSE {lines}[1:{first} - 1] END"
    return f"array_to_string(list_filter({own}, lambda l: NOT regexp_matches(l, '^>+ .*$')), chr(10))"


def _base(text: str) -> str:
    for name in views.TABLES:
        text = text.replace("{" + name + "}", name)
    return text.replace("{v_messages}", "v_messages")


CTES = {
    "v_messages": _base(views.MESSAGES),
    "v_mail": _base(views.MAIL),
    "v_rules": views.RULES,
    "v_contacts": _base(views.CONTACTS),
    "v_folders": _base(views.FOLDERS),
    "v_errors": _base(views.ERRORS),
    "v_raw": _base(views.RAW),
    "v_decisions": _base(views.DECISIONS),
    "v_filters": _base(views.FILTERS),
    "v_stats": stats("v_messages"),
    "v_old_messages": f"SELECT * FROM v_messages WHERE date_received < TIMESTAMP '{views.STORED_BEFORE}'",
    "v_old_stats": stats("v_old_messages"),
    "v_stored": """
SELECT sender_email,
  CASE email_count % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'company' WHEN 2 THEN 'newsletter' END AS sender_type,
  CAST(0.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (email_count % 5) AS sender_type_confidence,
  CASE email_count % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'llm' ELSE 'heuristic' END AS sender_type_source,
  email_count % 2 = 0 AS extraction_candidate,
  CASE WHEN email_count % 6 = 0 THEN 'automated' END AS reviewed_sender_type,
  CASE WHEN email_count % 3 = 0 THEN TIMESTAMP '2024-01-10 00:00:00' END AS reviewed_at,
  CASE WHEN email_count % 3 = 0 THEN TIMESTAMP '2024-01-11 00:00:00' END AS processed_at,
  'keep' AS user_decision, email_count, thread_count, first_email_date, last_email_date
FROM v_old_stats""",
    "v_fresh": """
SELECT *, CASE WHEN email_count % 2 = 0 THEN 'company' END AS sender_type,
  CASE WHEN email_count % 2 = 0 THEN CAST(0.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (email_count % 4) END AS sender_type_confidence,
  CASE WHEN email_count % 2 = 0 THEN 'llm' END AS sender_type_source FROM v_stats""",
    "v_heuristic": heuristic("v_stats"),
    "v_sender_results": """
SELECT sender_email AS email, CASE email_count % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'newsletter' ELSE 'human' END AS result_type,
  CASE WHEN email_count % 2 = 0 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.65 AS DOUBLE) END AS result_confidence FROM v_stats WHERE sender_name <> ''""",
    "v_unreviewed": f"SELECT *, {NO_REVIEW} FROM v_heuristic",
    "v_enriched": enriched("v_unreviewed"),
    "v_state": scored("v_enriched"),
    "v_latest": """
SELECT * EXCLUDE (rn) FROM (SELECT *, lower(trim(sender_email)) AS sender_key, row_number() OVER (PARTITION BY lower(trim(sender_email))
  ORDER BY decided_at DESC, log_seq) AS rn FROM v_decisions) WHERE rn = 1""",
    "v_noise": "SELECT sender_key, user_decision AS action FROM v_latest WHERE user_decision <> 'keep'",
    "v_manifest": """
SELECT 'r1' AS run_id, concat('b-', s.sender_type) AS batch_id, 'prepared' AS status, s.sender_email, s.sender_name, s.email_count,
  s.unread_ratio, s.last_email_date, s.sender_type AS presented_sender_type, d.reviewed_type AS reviewed_sender_type,
  s.recommended_action AS system_recommendation, d.user_decision, d.user_decision = 'filter' AS filter_applied,
  CASE WHEN s.email_count % 4 = 0 THEN 'done' ELSE 'pending' END AS filter_status,
  CASE WHEN s.email_count % 4 = 0 THEN 'done' ELSE 'pending' END AS archive_status,
  CASE WHEN s.email_count % 4 = 0 THEN 'done' ELSE 'pending' END AS log_status, 'pending' AS state_status,
  CASE WHEN s.email_count % 3 = 0 THEN 'done' ELSE 'pending' END AS sheet_status, d.messages_archived
FROM v_state s JOIN v_latest d ON d.sender_key = s.sender_email""",
    "v_heads": heads("v_mail"),
    "v_parts": f"""
SELECT thread_id, string_agg(piece, chr(10) || chr(10) ORDER BY date_received, ingest_seq) FILTER (WHERE piece <> '') AS content,
  string_agg(message_id, ',' ORDER BY date_received, ingest_seq) AS message_ids
FROM (SELECT *, regexp_replace({unique_content('body')}, '^\\s+|\\s+$', '', 'g') AS piece FROM v_mail) GROUP BY 1""",
    "v_participants": """
SELECT thread_id, string_agg(sender_email, ',' ORDER BY date_received, ingest_seq) AS participants FROM
 (SELECT *, row_number() OVER (PARTITION BY thread_id, sender_email ORDER BY date_received, ingest_seq) AS rn FROM v_mail)
WHERE rn = 1 GROUP BY 1""",
    "v_by_rule": f"""
SELECT thread_id, category, CAST(1 AS DOUBLE) AS confidence, last_date >= TIMESTAMP '{views.AS_OF}' - INTERVAL 365 DAY AS actionable,
  '' AS summary, 'rule' AS classified_by, rule_name FROM
 (SELECT h.*, CASE WHEN s.rule_key IS NOT NULL THEN s.category ELSE d.category END AS category,
   CASE WHEN s.rule_key IS NOT NULL THEN 'sender:' || s.rule_key ELSE 'domain:' || d.rule_key END AS rule_name
  FROM v_heads h LEFT JOIN v_rules s ON s.kind = 'sender' AND s.rule_key = lower(trim(h.sender_email))
  LEFT JOIN v_rules d ON d.kind = 'domain' AND d.rule_key = split_part(lower(trim(h.sender_email)), '@', 2))
 WHERE category IS NOT NULL""",
    "v_thread_results": """
SELECT thread_id, concat('about ', lower(subject)) AS category, CASE WHEN message_count > 4 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS confidence,
  message_count > 3 AS actionable, concat('On ', subject) AS summary FROM v_heads WHERE subject <> 'Topic 0'""",
    "v_by_model": f"""
SELECT h.thread_id, coalesce(r.category, 'uncategorized') AS category, coalesce(CAST(r.confidence AS DOUBLE), 0) AS confidence,
  coalesce(r.actionable, false) AND h.last_date >= TIMESTAMP '{views.AS_OF}' - INTERVAL 365 DAY AS actionable,
  coalesce(r.summary, 'Classification failed.') AS summary, 'llm' AS classified_by, CAST(NULL AS VARCHAR) AS rule_name
FROM v_heads h LEFT JOIN v_thread_results r USING (thread_id) WHERE h.thread_id NOT IN (SELECT thread_id FROM v_by_rule)""",
    "v_classified": "SELECT * FROM v_by_rule UNION ALL SELECT * FROM v_by_model",
    "v_label_ids": """
SELECT name, concat('Label_', name) AS label_id FROM (SELECT DISTINCT category AS name FROM v_classified WHERE category <> 'uncategorized'
  UNION SELECT '_triage')""",
    "v_closure": """
SELECT DISTINCT id FROM (WITH RECURSIVE c(id) AS (SELECT id FROM v_folders WHERE display_name IN ('Drafts','Sent Items','Deleted Items',
  'Junk Email','Outbox','Conversation History','Sync Issues') UNION SELECT f.id FROM v_folders f JOIN c ON f.parent_id = c.id) SELECT id FROM c)""",
    "v_leveled": """
SELECT *, CASE WHEN kind IN ('message', 'system') THEN kind WHEN coalesce(message_id, '') <> '' THEN 'message'
  WHEN regexp_matches(message, '^Message ([^:]+):') THEN 'message' ELSE 'system' END AS level,
  nullif(regexp_extract(message, '^Message ([^:]+):', 1), '') AS named_id FROM v_errors""",
    "v_targets": """
SELECT DISTINCT id AS message_id FROM (SELECT CASE WHEN coalesce(message_id, '') <> '' THEN message_id ELSE named_id END AS id FROM v_leveled)
WHERE id IS NOT NULL""",
    # Staged rows: starred mail was recovered.
    "v_recovered": """
SELECT DISTINCT message_id FROM v_messages WHERE list_contains(string_split(label_csv, ','), 'STARRED')
  AND message_id IN (SELECT message_id FROM v_targets)""",
    "v_triage": "SELECT * FROM v_messages WHERE list_contains(string_split(label_csv, ','), '_triage')",
}

_NAME = re.compile(r"\bv_\w+")


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with the CTEs it uses, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in CTES and name not in ordered:
                visit(CTES[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered) + "\n" + sql
