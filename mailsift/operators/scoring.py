"""Noise score, heuristic sender type and extraction score: narrow projections only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.address import domain, in_domains, local_part, trim_all
from mailsift.functions.measure import at

# Fixed values of the noise score.
NOREPLY_LOCAL_PARTS = ["noreply", "no-reply", "notifications"]
MARKETING_DOMAINS = [
    "mailchimp.com",
    "sendgrid.net",
    "constantcontact.com",
    "klaviyo.com",
    "campaignmonitor.com",
    "marketo.net",
    "salesforce.com",
    "hubspot.com",
    "mailgun.org",
    "amazonses.com",
    "postmarkapp.com",
    "sparkpostmail.com",
]
# Domains that the o365 dialect treats as a hint instead of an override.
SOFT_MARKETING_DOMAINS = ["salesforce.com", "hubspot.com"]
SOFT_MARKETING_FLOOR = 0.6
WEIGHTS = {"unread": 0.3, "category": 0.2, "recency": 0.15, "threads": 0.1, "type": 0.25}
CATEGORY_NOISE = {"promotions": 1.0, "social": 0.8, "updates": 0.6, "forums": 0.5, "primary": 0.0}
TYPE_NOISE = {"human": 0.0, "company": 0.5, "newsletter": 0.8, "automated": 0.9, "unknown": 0.5}
NEUTRAL = 0.5
RECENT_DAYS, MODERATE_DAYS = 90, 365
MANY_THREADS, SOME_THREADS = 10, 3
TIER_CUTS = [
    (0.7, "definitely_noise", "unsubscribe"),
    (0.5, "probably_noise", "filter"),
    (0.3, "probably_keep", "keep"),
]
SURPRISE_UNREAD, SURPRISE_COUNT = 0.8, 20

# Fixed values of the heuristic sender type.
HARD_AUTOMATED_LOCAL_PARTS = ["noreply", "no-reply", "notifications", "mailer", "digest"]
HARD_CONFIDENCE = 0.95
FREEMAIL_DOMAINS = [
    "gmail.com",
    "yahoo.com",
    "hotmail.com",
    "outlook.com",
    "icloud.com",
    "aol.com",
    "protonmail.com",
    "proton.me",
    "mail.com",
    "zoho.com",
    "yandex.com",
    "gmx.com",
    "fastmail.com",
    "tutanota.com",
    "hey.com",
    "live.com",
    "msn.com",
    "me.com",
    "mac.com",
    "yahoo.co.uk",
]
SOFT_AUTOMATED_LOCAL_PARTS = [
    "support",
    "billing",
    "info",
    "team",
    "hello",
    "updates",
    "news",
    "marketing",
    "contact",
    "admin",
    "sales",
]
CORPORATE_NAME = r"(?i)\b(team|inc|llc|corp)\b"
NEWSLETTER_NAME = r"(?i)\b(newsletter|updates|digest|news|weekly|daily|monthly)\b"
HUMAN_NAME = r"^[A-Z][a-z]{1,20}(\s[A-Z][a-z]{1,20}){1,2}\z"
TEMPLATE_SUBJECTS = [
    r"(?i)your\s+(order|receipt|invoice|statement|subscription|account)",
    r"(?i)order\s*#",
    r"(?i)shipping\s+(update|confirmation|notification)",
    r"(?i)(weekly|daily|monthly)\s+(digest|report|summary|update|roundup)",
]
CONVERSATION_SUBJECTS = [r"^Re:\s", r"^Fwd:\s"]
TYPE_CUT = 0.6

# Fixed values of the extraction score.
EXTRACTION_MIN_COUNT = 3
EXTRACTION_CUT = 0.5


def _lookup(key: Column, table: dict[str, float]) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), F.lit(NEUTRAL))


def score_confidence(stats: DataFrame, as_of, dialect: str = "gmail") -> DataFrame:
    """Add noise_score, confidence_tier, recommended_action and surprises_flag.

    ``noise_score`` is NULL where an override or the one-mail default decides.
    """
    hard, soft = list(MARKETING_DOMAINS), []
    if dialect == "o365":
        soft = SOFT_MARKETING_DOMAINS
        hard = [d for d in MARKETING_DOMAINS if d not in soft]
    sender_type = F.col("sender_type") if "sender_type" in stats.columns else F.lit("unknown")
    host = domain("sender_email")
    last = F.col("last_email_date")

    def since(days: int) -> Column:
        return last >= at(as_of) - F.expr(f"INTERVAL {days} DAYS")

    recency = F.when(since(RECENT_DAYS), F.lit(0.0)).when(since(MODERATE_DAYS), F.lit(0.4)).otherwise(F.lit(0.9))
    threads = (
        F.when(F.col("thread_count") > MANY_THREADS, F.lit(0.0))
        .when(F.col("thread_count") > SOME_THREADS, F.lit(0.3))
        .otherwise(F.lit(0.8))
    )
    type_noise = _lookup(F.coalesce(sender_type, F.lit("unknown")), TYPE_NOISE)
    if soft:
        floor = F.greatest(type_noise, F.lit(SOFT_MARKETING_FLOOR))
        type_noise = F.when(in_domains(host, soft), floor).otherwise(type_noise)
    category = F.lower("category")
    score = (
        F.lit(WEIGHTS["unread"]) * F.col("unread_ratio")
        + F.lit(WEIGHTS["category"]) * _lookup(category, CATEGORY_NOISE)
        + F.lit(WEIGHTS["recency"]) * recency
        + F.lit(WEIGHTS["threads"]) * threads
        + F.lit(WEIGHTS["type"]) * type_noise
    )
    override = local_part("sender_email").isin(NOREPLY_LOCAL_PARTS) | in_domains(host, hard)
    single = F.col("email_count") <= 1
    surprise = (
        (category == "primary")
        & (F.col("unread_ratio") > F.lit(SURPRISE_UNREAD))
        & (F.col("email_count") > SURPRISE_COUNT)
    )
    scored = stats.withColumn("_override", override).withColumn(
        "noise_score", F.when(~F.col("_override") & ~single, score)
    )
    tier = F.when(F.col("_override"), F.lit("definitely_noise")).when(single, F.lit("probably_keep"))
    action = F.when(F.col("_override"), F.lit("unsubscribe")).when(single, F.lit("keep"))
    for cut, tier_name, action_name in TIER_CUTS:
        reached = F.col("noise_score") >= F.lit(cut)
        tier, action = tier.when(reached, tier_name), action.when(reached, action_name)
    return (
        scored.withColumn("confidence_tier", tier.otherwise("definitely_keep"))
        .withColumn("recommended_action", action.otherwise("keep"))
        .withColumn("surprises_flag", F.col("noise_score").isNotNull() & surprise)
        .drop("_override")
    )


def _votes(*terms: tuple[Column, float | Column]) -> Column:
    """Sum of the votes that apply, added in the order given."""
    total = F.lit(0.0)
    for applies, weight in terms:
        weight = weight if isinstance(weight, Column) else F.lit(weight)
        total = total + F.when(applies, weight).otherwise(F.lit(0.0))
    return total


def _share(subjects: Column, patterns: list[str]) -> Column:
    """Share of subjects that match any pattern; 0 when there are none."""
    hits = F.size(F.filter(subjects, lambda s: reduce(lambda a, b: a | b, [s.rlike(p) for p in patterns])))
    return F.when(F.size(subjects) > 0, hits / F.size(subjects)).otherwise(F.lit(0.0))


def classify_heuristic(stats: DataFrame) -> DataFrame:
    """Add heuristic_type and heuristic_confidence from explainable votes."""
    local, host = local_part("sender_email"), domain("sender_email")
    name = trim_all("sender_name")
    named = name != ""
    ratio = F.when(F.col("email_count") > 0, F.col("thread_count") / F.col("email_count"))
    newsletter_name = named & name.rlike(NEWSLETTER_NAME)
    low_ratio = F.coalesce(ratio <= F.lit(0.1), F.lit(False))
    template = F.col("_template")
    chat = F.col("_chat")

    human = _votes(
        (host.isin(FREEMAIL_DOMAINS), 0.7),
        (named & name.rlike(HUMAN_NAME), 0.4),
        (F.coalesce(ratio >= F.lit(0.7), F.lit(False)), 0.3),
        (chat > 0, F.lit(0.3) * chat),
    )
    company = _votes((named & ~newsletter_name & name.rlike(CORPORATE_NAME), 0.5))
    newsletter = _votes(
        (newsletter_name, 0.5),
        (low_ratio, 0.2),
        (template > 0, F.lit(0.5) * template),
    )
    automated = _votes(
        (local.isin(SOFT_AUTOMATED_LOCAL_PARTS), 0.3),
        (~named | (F.lower(name) == local), 0.3),
        (low_ratio, 0.2),
        (template > 0, F.lit(0.2) * template),
    )
    voted = (
        stats.withColumn("_template", _share(F.col("sample_subjects"), TEMPLATE_SUBJECTS))
        .withColumn("_chat", _share(F.col("sample_subjects"), CONVERSATION_SUBJECTS))
        .withColumn("_human", human)
        .withColumn("_company", company)
        .withColumn("_newsletter", newsletter)
        .withColumn("_automated", automated)
        .withColumn("_best", F.greatest("_human", "_company", "_newsletter", "_automated"))
    )
    hard = local.isin(HARD_AUTOMATED_LOCAL_PARTS)
    winner = (
        F.when(hard, "automated")
        .when(F.col("_best") < F.lit(TYPE_CUT), "unknown")
        .when(F.col("_automated") == F.col("_best"), "automated")
        .when(F.col("_newsletter") == F.col("_best"), "newsletter")
        .when(F.col("_company") == F.col("_best"), "company")
        .otherwise("human")
    )
    confidence = F.when(hard, F.lit(HARD_CONFIDENCE)).otherwise(F.least(F.col("_best"), F.lit(1.0)))
    return (
        voted.withColumn("heuristic_type", winner)
        .withColumn("heuristic_confidence", confidence)
        .drop("_template", "_chat", "_human", "_company", "_newsletter", "_automated", "_best")
    )


def extraction_score() -> Column:
    """Value of a sender's mail for content extraction, 0 to 1."""
    count = F.col("email_count")
    reply = F.least((F.col("thread_count") / count) / F.lit(0.5), F.lit(1.0))
    read = F.lit(1.0) - F.col("unread_ratio")
    explicit = F.least(((F.col("starred_count") + F.col("important_count")) / count) / F.lit(0.1), F.lit(1.0))
    content = _votes(
        (F.coalesce(F.col("sender_type") == "human", F.lit(False)), 0.5),
        (F.col("category") == "primary", 0.3),
        (count >= EXTRACTION_MIN_COUNT, 0.2),
    )
    return (
        F.lit(0.4) * reply + F.lit(0.3) * read + F.lit(0.2) * explicit + F.lit(0.1) * content
    )


def score_extraction(stats: DataFrame) -> DataFrame:
    """Add extraction_candidate; senders with fewer than three messages never qualify."""
    enough = F.col("email_count") >= EXTRACTION_MIN_COUNT
    return stats.withColumn(
        "extraction_candidate",
        F.when(enough, extraction_score() >= F.lit(EXTRACTION_CUT)).otherwise(F.lit(False)),
    )
