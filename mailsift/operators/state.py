"""Sender state: enrichment results, merge with stored state, review results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.address import decision_key, sender_key
from mailsift.functions.measure import at

# Review fields of a sender and their types.
REVIEW_FIELDS = {
    "sender_type": "string",
    "sender_type_confidence": "double",
    "sender_type_source": "string",
    "extraction_candidate": "boolean",
    "reviewed_sender_type": "string",
    "reviewed_at": "timestamp_ntz",
    "processed_at": "timestamp_ntz",
}
# Further optional fields; the o365 dialect keeps stored values of these.
OPTIONAL_FIELDS = {"confidence_tier": "string", "recommended_action": "string", "user_decision": "string"}


def with_optional(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Add the missing ones of ``fields`` as typed NULLs."""
    for name, kind in fields.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def merge_state(fresh: DataFrame, stored: DataFrame, dialect: str = "gmail") -> DataFrame:
    """Fresh statistics with the review fields of stored state.

    A user's type wins; of two model types the more confident one, the stored one when
    equal; other review fields fill in where fresh has none. Senders that are no longer
    in ``fresh`` drop out.
    """
    fields = REVIEW_FIELDS | OPTIONAL_FIELDS
    fresh = with_optional(fresh, fields)
    stored = with_optional(stored, fields)
    old = stored.select(
        sender_key("sender_email").alias("_key"), *[F.col(f).alias(f"_old_{f}") for f in fields]
    )
    joined = fresh.withColumn("_key", sender_key("sender_email")).join(old, "_key", "left")

    by_user = F.coalesce(F.col("_old_sender_type_source") == "user", F.lit(False))
    by_models = (F.col("_old_sender_type_source") == "llm") & (F.col("sender_type_source") == "llm")
    old_better = F.coalesce("_old_sender_type_confidence", F.lit(0.0)) >= F.coalesce(
        "sender_type_confidence", F.lit(0.0)
    )
    keep_old = F.coalesce(by_models & old_better, F.lit(False))

    def fill(name: str) -> Column:
        return F.coalesce(name, f"_old_{name}")

    def typed(name: str, of_user: Column) -> Column:
        return F.when(by_user, of_user).when(keep_old, F.col(f"_old_{name}")).otherwise(fill(name)).alias(name)

    merged = {
        "sender_type": typed("sender_type", F.coalesce("_old_reviewed_sender_type", "_old_sender_type")),
        "sender_type_confidence": typed("sender_type_confidence", F.col("_old_sender_type_confidence")),
        "sender_type_source": typed("sender_type_source", F.lit("user")),
        "reviewed_sender_type": F.when(by_user, F.col("_old_reviewed_sender_type"))
        .otherwise(fill("reviewed_sender_type"))
        .alias("reviewed_sender_type"),
        "reviewed_at": F.when(by_user, F.col("_old_reviewed_at")).otherwise(fill("reviewed_at")).alias("reviewed_at"),
        "extraction_candidate": fill("extraction_candidate").alias("extraction_candidate"),
        "processed_at": fill("processed_at").alias("processed_at"),
    }
    for name in OPTIONAL_FIELDS:
        value = fill(name) if dialect == "o365" else F.col(name)
        merged[name] = value.alias(name)
    return joined.select(*[merged.get(c, F.col(c)) for c in fresh.columns])


def apply_review(state: DataFrame, manifest: DataFrame, now) -> DataFrame:
    """State after a reviewed batch: processed time, and the reviewed type where one is set."""
    done = manifest.select(
        sender_key("sender_email").alias("_key"),
        F.col("reviewed_sender_type").alias("_reviewed"),
        F.lit(True).alias("_in_batch"),
    )
    state = with_optional(state, REVIEW_FIELDS)
    joined = state.withColumn("_key", sender_key("sender_email")).join(done, "_key", "left")
    reviewed = F.col("_reviewed").isNotNull()
    changed = {
        "processed_at": F.when(F.col("_in_batch"), at(now)).otherwise(F.col("processed_at")),
        "sender_type": F.coalesce("_reviewed", "sender_type"),
        "reviewed_sender_type": F.coalesce("_reviewed", "reviewed_sender_type"),
        "reviewed_at": F.when(reviewed, at(now)).otherwise(F.col("reviewed_at")),
        "sender_type_source": F.when(reviewed, "user").otherwise(F.col("sender_type_source")),
        "sender_type_confidence": F.when(~reviewed, F.col("sender_type_confidence")),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in state.columns])


def model_result_columns(results: DataFrame) -> DataFrame:
    """Model results (email, sender_type, confidence) as join columns (_key, _type, _confidence)."""
    return results.select(
        sender_key("email").alias("_key"),
        F.col("sender_type").alias("_type"),
        F.col("confidence").alias("_confidence"),
    )


def apply_sender_results(senders: DataFrame, results: DataFrame) -> DataFrame:
    """Model results onto senders; no result means unknown with confidence 0."""
    joined = senders.withColumn("_key", sender_key("sender_email")).join(model_result_columns(results), "_key", "left")
    typed = {
        "sender_type": F.coalesce("_type", F.lit("unknown")),
        "sender_type_confidence": F.coalesce("_confidence", F.lit(0.0)),
        "sender_type_source": F.when(F.col("_type").isNotNull(), F.lit("llm")),
    }
    plain = [c for c in senders.columns if c not in typed]
    return joined.select(*plain, *[value.alias(name) for name, value in typed.items()])


def rescore_candidates(state: DataFrame, manifests: DataFrame, cut: float = 0.7) -> DataFrame:
    """Unknown or low-confidence senders that no open batch holds.

    ``manifests`` has one row per (status, sender_email).
    """
    open_batches = manifests.filter(F.col("status").isin("prepared", "executing")).select(
        sender_key("sender_email").alias("_key")
    )
    doubtful = (F.coalesce("sender_type", F.lit("unknown")) == "unknown") | (
        F.coalesce("sender_type_confidence", F.lit(0.0)) < F.lit(cut)
    )
    picked = state.filter(doubtful).withColumn("_key", sender_key("sender_email"))
    return picked.join(open_batches, "_key", "left_anti").drop("_key")


def contact_links(contacts: DataFrame, state: DataFrame) -> DataFrame:
    """Contact e-mails (name, emails array) joined with sender state on the address, once per name and address."""
    listed = contacts.select("name", F.explode("emails").alias("_mail")).select(
        "name", decision_key(F.col("_mail")["value"]).alias("_key")
    )
    listed = listed.filter(F.col("_key") != "").distinct()
    known = state.withColumn("_key", sender_key("sender_email"))
    return listed.join(known, "_key").drop("_key")


def identity_links(contacts: DataFrame, state: DataFrame) -> DataFrame:
    """Per contact: volume and recency over all matched senders.

    ``contacts`` has a ``contact_id``, unique per contact; names and phones may repeat.
    """
    phones = F.array_join(F.coalesce(F.transform("phones", lambda p: p["value"]), F.array()), ",")
    listed = contacts.select("contact_id", "name", phones.alias("phones"), F.explode("emails").alias("_mail")).select(
        "contact_id", "name", "phones", decision_key(F.col("_mail")["value"]).alias("_key")
    )
    known = state.withColumn("_key", sender_key("sender_email"))
    joined = listed.filter(F.col("_key") != "").dropDuplicates(["contact_id", "_key"]).join(known, "_key")
    main = F.max_by("sender_type", F.struct("email_count", "sender_email"))
    return joined.groupBy("contact_id", "name", "phones").agg(
        F.count(F.lit(1)).alias("senders"),
        F.sum("email_count").alias("email_count"),
        F.max("last_email_date").alias("last_email_date"),
        main.alias("sender_type"),
    )
