"""Threads: collapse, rules, model results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.address import decision_key, domain, trim_all
from mailsift.functions.measure import arrival_order, within_days
from mailsift.functions.text import unique_content
from mailsift.joins import spread_join
from mailsift.ranking import number_by_order

def thread_heads(messages: DataFrame) -> DataFrame:
    """First sender and subject, date range and message count per thread.

    Only decomposable aggregates, so a thread of any length is reduced map-side.
    """
    first = F.min(
        F.struct("date_received", "ingest_seq", F.col("sender.email").alias("email"), "subject")
    )
    return (
        messages.groupBy("thread_id")
        .agg(
            first.alias("_first"),
            F.max("date_received").alias("last_date"),
            F.min("ingest_seq").alias("first_seq"),
            F.count(F.lit(1)).alias("message_count"),
        )
        .select(
            "thread_id",
            F.col("_first.email").alias("sender_email"),
            F.col("_first.subject").alias("subject"),
            F.col("_first.date_received").alias("first_date"),
            "last_date",
            "message_count",
            "first_seq",
        )
    )


def with_bodies(messages: DataFrame, bodies: DataFrame) -> DataFrame:
    """Add ``body``; a message without one gets an empty text."""
    joined = messages.join(bodies.select("message_id", F.col("body").alias("_body")), "message_id", "left")
    return joined.withColumn("body", F.coalesce("_body", F.lit(""))).drop("_body")


def thread_entries(messages: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """The pieces of every thread: (thread_id, position, message_id, email, content), from position 1.

    Positions follow time, then sequence. One row per message, so a thread of any length
    has the same shape, and no task gathers one. Without bodies the contents are empty.
    """
    full = messages if bodies is None else with_bodies(messages, bodies)
    body = F.col("body") if "body" in full.columns else F.lit("")
    entries = full.select(
        "thread_id",
        "date_received",
        "ingest_seq",
        "message_id",
        F.col("sender.email").alias("email"),
        trim_all(unique_content(body)).alias("content"),
    )
    placed = number_by_order(entries, ["thread_id"], ["date_received", "ingest_seq"], "position")
    return placed.select("thread_id", "position", "message_id", "email", "content")


def collapse_threads(messages: DataFrame) -> DataFrame:
    """One row per thread: its head and the number of its participants.

    ``thread_participants`` and ``thread_entries`` hold the parts of a thread as rows.
    """
    people = thread_participants(messages).groupBy("thread_id").agg(F.count(F.lit(1)).alias("participants"))
    return thread_heads(messages).join(people, "thread_id")


def thread_messages(messages: DataFrame) -> DataFrame:
    """Message ids per thread in time order: (thread_id, position, message_id)."""
    return thread_entries(messages).select("thread_id", "position", "message_id")


def thread_participants(messages: DataFrame) -> DataFrame:
    """Distinct participants per thread: (thread_id, participant, first_date, first_seq, messages)."""
    arrival = arrival_order("date_received", "ingest_seq")
    return (
        messages.groupBy("thread_id", F.col("sender.email").alias("participant"))
        .agg(
            F.min("date_received").alias("first_date"),
            F.min_by("ingest_seq", arrival).alias("first_seq"),
            F.count(F.lit(1)).alias("messages"),
        )
    )


def match_rules(threads: DataFrame, rules: DataFrame) -> DataFrame:
    """Add sender_matched, sender_category, domain_matched, domain_category.

    A matched key and its category are separate facts: a rule may have no category.
    ``rules`` is (kind, rule_key, category) with lower-case keys, unique per kind. No
    broadcast is forced; adaptive execution broadcasts rules whose measured size allows.
    """

    def of(kind: str) -> DataFrame:
        return rules.filter(F.col("kind") == kind).select(
            F.col("rule_key").alias(f"{kind}_key"),
            F.lit(True).alias(f"{kind}_matched"),
            F.col("category").alias(f"{kind}_category"),
        )

    keyed = threads.withColumn("sender_key", decision_key("sender_email"))
    host = domain("sender_key")
    keyed = keyed.withColumn("domain_key", F.when(host != "", host))
    joined = keyed.join(of("sender"), "sender_key", "left").join(of("domain"), "domain_key", "left")
    return joined.withColumn("sender_matched", F.coalesce("sender_matched", F.lit(False))).withColumn(
        "domain_matched", F.coalesce("domain_matched", F.lit(False))
    )


def _rule_columns(as_of) -> dict[str, Column]:
    """Classification by a matched rule; the category is NULL where no rule decides.

    A sender rule beats a domain rule, also when its own category is NULL: such a thread
    is left to the model.
    """
    by_sender = F.col("sender_matched")
    rule = F.when(by_sender, F.concat(F.lit("sender:"), "sender_key")).otherwise(
        F.concat(F.lit("domain:"), "domain_key")
    )
    return {
        "category": F.when(by_sender, F.col("sender_category")).otherwise(F.col("domain_category")),
        "confidence": F.lit(1.0),
        "actionable": within_days("last_date", as_of),
        "summary": F.lit(""),
        "classified_by": F.lit("rule"),
        "rule_name": rule,
    }


def classify_rules(threads: DataFrame, rules: DataFrame, as_of) -> DataFrame:
    """Classifications of the threads that a rule decides."""
    columns = [value.alias(name) for name, value in _rule_columns(as_of).items()]
    return match_rules(threads, rules).select("thread_id", *columns).filter(F.col("category").isNotNull())


def unmatched_threads(threads: DataFrame, classified: DataFrame) -> DataFrame:
    return threads.join(classified.select("thread_id"), "thread_id", "left_anti")


def unmatched_messages(messages: DataFrame, classified: DataFrame) -> DataFrame:
    """Messages of threads that no classification covers yet."""
    return spread_join(messages, classified.select("thread_id").distinct(), "thread_id", "left_anti")


def _result_columns(as_of) -> dict[str, Column]:
    """Classification by a joined model result; without one the thread is uncategorized.

    A thread older than a year is never actionable.
    """
    hit = F.coalesce("_found", F.lit(False))
    return {
        "category": F.when(hit, F.col("_category")).otherwise("uncategorized"),
        "confidence": F.when(hit, F.col("_confidence")).otherwise(F.lit(0.0)),
        "actionable": hit & F.coalesce("_actionable", F.lit(False)) & within_days("last_date", as_of),
        "summary": F.when(hit, F.col("_summary")).otherwise("Classification failed."),
        "classified_by": F.lit("llm"),
        "rule_name": F.lit(None).cast("string"),
    }


def _result_table(results: DataFrame) -> DataFrame:
    named = [F.col(c).alias(f"_{c}") for c in ("category", "confidence", "actionable", "summary")]
    return results.select(F.col("thread_id").alias("_result_id"), *named, F.lit(True).alias("_found"))


def apply_thread_results(threads: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """Classifications of ``threads`` from model results."""
    table = _result_table(results)
    joined = threads.join(table, threads["thread_id"] == table["_result_id"], "left")
    columns = [value.alias(name) for name, value in _result_columns(as_of).items()]
    return joined.select("thread_id", *columns)


def classify_all(
    threads: DataFrame, rules: DataFrame, results: DataFrame, as_of, keep: Sequence[str] = ()
) -> DataFrame:
    """Every thread once: by rule where one decides, else by model result.

    Only threads without a deciding rule carry a join key for the results, so the union
    of both kinds takes one pass. ``keep`` names thread columns to carry along.
    """
    by_rule, by_model = _rule_columns(as_of), _result_columns(as_of)
    matched = match_rules(threads, rules).withColumn("_rule_category", by_rule["category"])
    ruled = F.col("_rule_category").isNotNull()
    table = _result_table(results)
    joined = matched.withColumn("_open_id", F.when(~ruled, F.col("thread_id"))).join(
        table, F.col("_open_id") == F.col("_result_id"), "left"
    )
    columns = [F.when(ruled, by_rule[c]).otherwise(by_model[c]).alias(c) for c in by_rule]
    return joined.select("thread_id", *columns, *keep)


def all_classifications(by_rule: DataFrame, by_model: DataFrame) -> DataFrame:
    return by_rule.unionByName(by_model)


def known_categories(classifications: DataFrame) -> DataFrame:
    return classifications.select("category").distinct()


def rules_template(stats: DataFrame) -> DataFrame:
    """Every sender and every distinct domain as a rule without a category."""
    email = trim_all("sender_email")
    host = domain(email)
    candidates = stats.select(
        F.explode(
            F.array(
                F.struct(F.lit("sender").alias("kind"), email.alias("rule_key")),
                F.struct(F.lit("domain").alias("kind"), F.when(email != "", host).otherwise("").alias("rule_key")),
            )
        ).alias("r")
    ).select("r.kind", "r.rule_key")
    return (
        candidates.filter(F.col("rule_key") != "")
        .distinct()
        .withColumn("category", F.lit(None).cast("string"))
    )


def taxonomy_sample(
    heads: DataFrame, entries: DataFrame, n: int = 1000, max_chars: int | None = None
) -> DataFrame:
    """A sample of ``n`` threads, by hash of their ids, as subject, sender and content.

    ``max_chars`` cuts each content, for models with a limit; by default it is whole.
    """
    sample = heads.orderBy(F.md5("thread_id"), "thread_id").limit(n)
    pieces = entries.join(sample.select("thread_id"), "thread_id", "left_semi").filter("content <> ''")
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("position", "content")))["content"], "\n\n")
    contents = pieces.groupBy("thread_id").agg(joined.alias("_content"))
    content = F.coalesce("_content", F.lit(""))
    if max_chars is not None:
        content = F.substring(content, 1, max_chars)
    text = F.concat(F.lit("Subject: "), "subject", F.lit("\nFrom: "), "sender_email", F.lit("\n"), content)
    return sample.join(contents, "thread_id", "left").select("thread_id", "first_seq", text.alias("summary"))
