"""Consolidation of per-sender mailbox filters into packed ones, and its reconcile step.

Live filters are (filter_id, from_addr, query, add_labels, remove_labels).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.operators.decisions import latest_decisions
from mailsift.operators.noise import remove_labels_for
from mailsift.operators.packing import pack_or_queries
from mailsift.schema import INBOX, NOISE_ACTIONS, NOISE_LABEL, UNREAD
from mailsift.session import durable

# Filters a mailbox can hold.
MAX_FILTERS = 1000


def label_set(labels: Column | str) -> Column:
    """Labels as a sorted set; no labels is the empty set."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    return F.array_sort(F.array_distinct(F.coalesce(labels, F.array().cast("array<string>"))))


def action_signature(filters: DataFrame) -> DataFrame:
    """Add add_set and remove_set, by which two filters' actions are compared."""
    return filters.withColumn("add_set", label_set("add_labels")).withColumn("remove_set", label_set("remove_labels"))


def _is_noise_action(label: str) -> Column:
    adds = F.col("add_set") == F.array(F.lit(label))
    inbox = F.col("remove_set") == F.array(F.lit(INBOX))
    unread = F.col("remove_set") == F.array(F.lit(INBOX), F.lit(UNREAD))
    return adds & (inbox | unread)


def classify_filters(filters: DataFrame, decisions: DataFrame, label: str = NOISE_LABEL) -> DataFrame:
    """Add decision and kind: legacy-noise, stale-keep or other."""
    latest = latest_decisions(decisions).select("sender_key", F.col("user_decision").alias("decision"))
    keyed = action_signature(filters).withColumn("sender_key", F.lower("from_addr"))
    joined = keyed.join(latest, "sender_key", "left")
    noise = _is_noise_action(label)
    kind = (
        F.when(noise & F.col("decision").isin(NOISE_ACTIONS), "legacy-noise")
        .when(noise & (F.col("decision") == "keep"), "stale-keep")
        .otherwise("other")
    )
    return joined.withColumn("kind", kind)


def planned_filters(classified: DataFrame, label: str = NOISE_LABEL) -> DataFrame:
    """Packed filters for the senders that own a legacy filter, per action."""
    owners = (
        classified.filter(F.col("kind") == "legacy-noise")
        .select(F.col("decision").alias("action"), F.col("sender_key").alias("sender"))
        .distinct()
    )
    packed = pack_or_queries(owners, group=["action"])
    return packed.withColumn("add_labels", F.array(F.lit(label))).withColumn(
        "remove_labels", remove_labels_for(F.col("action"))
    )


_SIGNATURE = ["query", "add_set", "remove_set"]


def missing_filters(planned: DataFrame, live: DataFrame) -> DataFrame:
    """Planned filters that no live filter equals in query and action."""
    present = action_signature(live).filter(F.col("query").isNotNull()).select(*_SIGNATURE)
    return action_signature(planned).join(present, _SIGNATURE, "left_anti").select(planned.columns)


def delete_targets(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("kind").isin("legacy-noise", "stale-keep")).select(
        "filter_id", F.col("from_addr").alias("sender_email"), "kind"
    )


def consolidation_plan(filters: DataFrame, decisions: DataFrame, label: str = NOISE_LABEL) -> dict[str, DataFrame]:
    """The plan as tables: ``classified``, ``deletes``, ``planned`` and ``creates``.

    The plan is frozen: it is written down, so later decisions do not change it.
    """
    classified = durable(classify_filters(filters, decisions, label), "classified-filters")
    planned = durable(planned_filters(classified, label), "planned-filters")
    return {
        "classified": classified,
        "deletes": delete_targets(classified),
        "planned": planned,
        "creates": missing_filters(planned, filters),
    }


def migration_summary(plan: dict[str, DataFrame], delete_first: bool = False) -> DataFrame:
    """Filters to create and delete, slots freed and whether the limit would be exceeded: one row."""
    kinds = plan["classified"].agg(
        F.count(F.lit(1)).alias("existing"),
        F.count_if(F.col("kind") == "stale-keep").alias("stale"),
        F.count_if(F.col("kind") != "other").alias("deleted"),
    )
    counts = kinds.withColumn("created", plan["creates"].agg(F.count(F.lit(1))).scalar())
    base = F.col("existing") - (F.col("deleted") if delete_first else F.col("stale"))
    return counts.select(
        "existing",
        "created",
        "deleted",
        (F.col("deleted") - F.col("created")).alias("slots_freed"),
        (F.lit(MAX_FILTERS) - base).alias("headroom"),
        (F.col("created") > F.lit(MAX_FILTERS) - base).alias("over_limit"),
    )


def remaining_targets(plan: dict[str, DataFrame], live: DataFrame) -> dict[str, DataFrame]:
    """What is left of a frozen plan: deletes still live, creates not yet live."""
    return {
        "deletes": plan["deletes"].join(live.select("filter_id"), "filter_id", "left_semi"),
        "creates": missing_filters(plan["creates"], live),
    }


def reconcile(plan: dict[str, DataFrame], live: DataFrame) -> DataFrame:
    """Remaining deletes and creates of a frozen plan and whether it is satisfied: one row."""
    left = remaining_targets(plan, live)
    counts = left["deletes"].agg(F.count(F.lit(1)).alias("remaining_deletes"))
    counts = counts.withColumn("remaining_creates", left["creates"].agg(F.count(F.lit(1))).scalar())
    return counts.withColumn(
        "satisfied", (F.col("remaining_deletes") == 0) & (F.col("remaining_creates") == 0)
    )
