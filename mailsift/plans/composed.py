"""Whole jobs composed from operators: enrichment, classification, digest, backfill merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.functions.address import sender_key
from mailsift.functions.measure import at
from mailsift.operators import backfill as bf
from mailsift.operators import threads as th
from mailsift.operators.infer import score_threads
from mailsift.operators.noise import new_since
from mailsift.operators.scoring import classify_heuristic, score_confidence, score_extraction
from mailsift.operators.senders import sender_stats
from mailsift.operators.state import REVIEW_FIELDS, merge_state, model_result_columns, with_optional
from mailsift.ranking import assert_max_rows
from mailsift.session import durable

# Category names that a prompt can carry; more are an error, not a cut.
MAX_CATEGORIES = 10_000


def _guessed(stats: DataFrame) -> DataFrame:
    """Statistics with the heuristic type, ``_by_user`` and ``_sure``."""
    by_user = F.coalesce(F.col("sender_type_source") == "user", F.lit(False)) | F.col(
        "reviewed_sender_type"
    ).isNotNull()
    guessed = classify_heuristic(with_optional(stats, REVIEW_FIELDS)).withColumn("_by_user", by_user)
    return guessed.withColumn("_sure", F.col("_by_user") | (F.col("heuristic_type") != "unknown"))


def ambiguous_senders(stats: DataFrame) -> DataFrame:
    """Senders that neither a user nor the heuristics typed: the only ones a model is asked about."""
    helpers = ["_by_user", "_sure", "heuristic_type", "heuristic_confidence"]
    return _guessed(stats).filter(~F.col("_sure")).drop(*helpers)


def enrich(stats: DataFrame, model_results: DataFrame) -> DataFrame:
    """Typed senders with the extraction flag; ``model_results`` is (email, sender_type, confidence).

    User-reviewed types come first, then heuristics, then model results. Only ambiguous
    senders carry a join key, so one pass over the statistics does all three.
    """
    guessed = _guessed(stats)
    key = F.when(~F.col("_sure"), sender_key("sender_email"))
    joined = guessed.withColumn("_key", key).join(model_result_columns(model_results), "_key", "left")
    by_user, sure = F.col("_by_user"), F.col("_sure")
    typed = {
        "sender_type": F.when(by_user, F.coalesce("reviewed_sender_type", "sender_type", F.lit("unknown")))
        .when(sure, F.col("heuristic_type"))
        .otherwise(F.coalesce("_type", F.lit("unknown"))),
        "sender_type_confidence": F.when(by_user, F.col("sender_type_confidence"))
        .when(sure, F.col("heuristic_confidence"))
        .otherwise(F.coalesce("_confidence", F.lit(0.0))),
        "sender_type_source": F.when(by_user, "user").when(sure, "heuristic").when(F.col("_type").isNotNull(), "llm"),
    }
    columns = with_optional(stats, REVIEW_FIELDS).columns
    return score_extraction(joined.select(*[typed.get(c, F.col(c)).alias(c) for c in columns]))


def analyze(messages: DataFrame, stored: DataFrame, model_results: DataFrame, as_of, dialect: str = "gmail") -> DataFrame:
    """Messages to scored sender state: statistics, merge, enrichment, noise score."""
    merged = merge_state(sender_stats(messages), stored, dialect)
    return score_confidence(enrich(merged, model_results), as_of, dialect)


def classify_with_results(messages: DataFrame, rules: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """Classifications of all threads: rules first, given model results for the rest."""
    return th.classify_all(th.thread_heads(messages), rules, results, as_of)


def run_classification(
    messages: DataFrame, bodies: DataFrame, rules: DataFrame, scorer: Callable, as_of
) -> dict[str, DataFrame]:
    """Classification with a live scorer.

    Bodies are read late: the anti join on rule matches comes first, so only messages of
    unmatched threads meet the body table. The scorer is called with each thread and the
    categories that rules gave; threads for which it fails fall back, and are listed in
    ``errors``.
    """
    heads = th.thread_heads(messages)
    by_rule = durable(th.classify_rules(heads, rules, as_of), "by-rule")
    open_messages = th.unmatched_messages(messages, by_rule)
    categories = th.known_categories(by_rule)
    # The names in use are few, and every call to the model carries them.
    known = sorted(r["category"] for r in assert_max_rows(categories, MAX_CATEGORIES, "categories").collect())
    # Written down, so that no later action asks the model again.
    asked = score_threads(th.thread_entries(open_messages, bodies), scorer, known)
    results = durable(asked, "thread-results")
    answered = results.filter(F.col("error").isNull()).drop("error")
    by_model = th.apply_thread_results(th.unmatched_threads(heads, by_rule), answered, as_of)
    return {
        "classifications": th.all_classifications(by_rule, by_model),
        "categories": categories,
        "unmatched": open_messages,
        "errors": results.filter(F.col("error").isNotNull()).select("thread_id", "error"),
    }


def classification_counts(classifications: DataFrame) -> DataFrame:
    """Threads in all, by rule and by model: one row."""
    return classifications.agg(
        F.count(F.lit(1)).alias("threads"),
        F.count_if(F.col("classified_by") == "rule").alias("by_rule"),
        F.count_if(F.col("classified_by") == "llm").alias("by_model"),
    )


def digest_counts(messages: DataFrame, classifications: DataFrame) -> DataFrame:
    """New messages, categorized threads and actionable threads: one row."""
    counts = classifications.agg(
        F.count(F.lit(1)).alias("categorized"), F.count_if("actionable").alias("actionable")
    )
    return counts.withColumn("total_new", messages.agg(F.count(F.lit(1))).scalar())


def category_counts(classifications: DataFrame) -> DataFrame:
    return classifications.groupBy("category").agg(F.count(F.lit(1)).alias("threads"))


def digest(messages: DataFrame, rules: DataFrame, results: DataFrame, since, as_of) -> dict[str, DataFrame]:
    """Digest of mail since a date: classifications, counts, categories, actionable items."""
    fresh = new_since(messages, at(since))
    heads = ["sender_email", "subject", "first_seq"]
    described = th.classify_all(th.thread_heads(fresh), rules, results, as_of, keep=heads)
    return {
        "messages": fresh,
        "classifications": described,
        "counts": digest_counts(fresh, described),
        "categories": category_counts(described),
        "actionable": described.filter("actionable").select("thread_id", "sender_email", "subject", "category"),
    }


def backfill_merge(errors: DataFrame, staged: DataFrame, residuals: DataFrame) -> dict[str, DataFrame]:
    """Recovery run: targets, recovered rows, residual errors, the new error list, the report."""
    targets = durable(bf.recovery_ids(errors), "targets")
    recovered = durable(bf.recovered_rows(staged.join(targets, "message_id", "left_semi")), "recovered")
    residual = bf.residual_errors(residuals, targets, recovered)
    return {
        "targets": targets,
        "recovered": recovered,
        "residual": residual,
        "errors": bf.new_errors(errors, recovered),
        "report": bf.backfill_report(targets, recovered, residual),
    }
