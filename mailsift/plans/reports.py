"""Reports as rows of markdown lines with a sort key: (section, major, minor, line).

A report is written by sorting on the key; no report text is ever one string in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.measure import at, thousands, whole_percent, ymd
from mailsift.operators.review import BATCH, batch_summary, collated
from mailsift.session import durable

ORDER = ["section", "major", "minor"]


def _lines(df: DataFrame, section: int, major: Column, *lines: Column | str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's lines as rows; ``keep`` columns ride along."""
    texts = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    rows = df.select(*keep, major.cast("string").alias("major"), F.posexplode(texts).alias("minor", "line"))
    return rows.select(*keep, F.lit(section).alias("section"), "major", "minor", "line")


def _number(n: Column) -> Column:
    """A number as text that sorts like the number."""
    return F.lpad(n.cast("string"), 20, "0")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def digest_lines(digest: dict[str, DataFrame], as_of) -> DataFrame:
    """The daily digest; categories and items in the order in which threads were classified."""
    counts = durable(digest["counts"], "digest-counts")
    title = F.concat(F.lit("# Daily Digest — "), ymd(at(as_of)))
    some, top = counts.filter("total_new > 0"), F.lit("")
    order = F.concat(F.when(F.col("classified_by") == "rule", "0").otherwise("1"), _number(F.col("first_seq")))
    placed = durable(digest["classifications"].withColumn("_at", order), "digest-threads")
    categories = placed.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_at"))
    plural = F.when(F.col("n") == 1, "").otherwise("s")
    return _union(
        [
            _lines(counts.filter("total_new = 0"), 0, top, title, "", "No new mail"),
            _lines(
                some,
                0,
                top,
                title,
                "",
                F.concat(F.lit("**Total new messages:** "), F.col("total_new")),
                F.concat(F.lit("**Auto-categorized threads:** "), F.col("categorized")),
                F.concat(F.lit("**Actionable threads:** "), F.col("actionable")),
                "",
                "## Categories",
            ),
            _lines(
                categories,
                1,
                F.col("_at"),
                F.concat(F.lit("- "), "category", F.lit(": "), "n", F.lit(" thread"), plural),
            ),
            _lines(some, 2, top, "", "## Actionable Items"),
            _lines(some.filter("actionable = 0"), 3, top, "*(none)*"),
            _lines(
                placed.filter("actionable"),
                3,
                F.col("_at"),
                F.concat(F.lit("- **"), "sender_email", F.lit("** — "), "subject"),
            ),
            _lines(some, 4, top, ""),
        ]
    )


def action_lines(items: DataFrame, as_of) -> DataFrame:
    """The action report: a heading per category, then its items in locale order."""
    title = F.concat(F.lit("# Action Pass Report — "), ymd(at(as_of)))
    items = durable(items, "action-items")
    counts = items.agg(F.count(F.lit(1)).alias("n"))
    blank = F.lit("")
    empty = counts.filter("n = 0").select(blank.alias("category"), F.array(title, blank, F.lit("No actionable items to review.")).alias("t"))
    head = counts.filter("n > 0").select(blank.alias("category"), F.array(title, blank).alias("t"))
    headings = items.select("category").distinct().select(
        "category", F.array(F.concat(F.lit("## "), "category"), blank).alias("t")
    )

    def rows(df: DataFrame, section: int) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"),
            "category",
            F.lit("").alias("sender_email"),
            F.lit("").alias("subject"),
            F.lit("").alias("thread_id"),
            F.posexplode("t").alias("minor", "line"),
        )

    detail = F.array(
        F.concat(F.lit("- **From:** "), "sender_email"),
        F.concat(F.lit("  **Subject:** "), "subject"),
        F.concat(F.lit("  **Date:** "), F.col("date_received").cast("string")),
        F.concat(F.lit("  **Thread ID:** "), "thread_id"),
        F.concat(F.lit("  **Messages:** "), F.col("message_count")),
        F.concat(F.lit("  **Representative Message ID:** "), "representative_id"),
        blank,
    )
    body = items.select(
        F.lit(1).alias("section"), "category", "sender_email", "subject", "thread_id", F.posexplode(detail).alias("minor", "line")
    )
    return _union([rows(empty, 0), rows(head, 0), rows(headings, 1), body])


def action_order() -> list[Column]:
    """Order of the action report's lines: texts in locale order, as in ``order_action_items``."""
    return [F.col("section"), *[collated(c) for c in ("category", "sender_email", "subject", "thread_id")], F.col("minor")]


def brief_lines(manifest: DataFrame, headers: DataFrame) -> DataFrame:
    """The brief of each batch.

    ``headers`` is (run_id, batch_id, batch_type, grouping_reason,
    presented_recommendation, status, created_at as text).
    """
    top = F.lit("")
    info = headers.join(batch_summary(manifest), BATCH)
    text = lambda label, value: F.concat(F.lit(label), F.col(value))
    intro = _lines(
        info,
        0,
        top,
        text("# Batch Brief: ", "batch_id"),
        "",
        text("**Run ID:** ", "run_id"),
        text("**Batch ID:** ", "batch_id"),
        text("**Status:** ", "status"),
        text("**Created:** ", "created_at"),
        "",
        "## Batch Info",
        "",
        text("**Batch type:** ", "batch_type"),
        text("**Grouping reason:** ", "grouping_reason"),
        text("**Presented recommendation:** ", "presented_recommendation"),
        "",
        "## Summary",
        "",
        F.concat(F.lit("- **Sender count:** "), thousands("sender_count")),
        F.concat(F.lit("- **Total emails:** "), thousands("total_email_count")),
        F.concat(F.lit("- **Average unread ratio:** "), whole_percent("average_unread_ratio"), F.lit("%")),
        "",
        "## Senders",
        "",
        keep=tuple(BATCH),
    )
    place = _number(F.col("position"))
    senders = _lines(
        manifest,
        1,
        place,
        F.concat(
            F.col("position"),
            F.lit(". **"),
            "sender_email",
            F.lit("** ("),
            "sender_name",
            F.lit(") — "),
            thousands("email_count"),
            F.lit(" emails, "),
            whole_percent("unread_ratio"),
            F.lit("% unread — decision: **"),
            "user_decision",
            F.lit("**"),
        ),
        keep=tuple(BATCH),
    )
    corrected = manifest.filter(F.col("reviewed_sender_type") != F.col("presented_sender_type"))
    heading = _lines(corrected.select(*BATCH).distinct(), 2, top, "", "## Type Corrections", "", keep=tuple(BATCH))
    corrections = _lines(
        corrected,
        3,
        place,
        F.concat(
            F.lit("- **"), "sender_email", F.lit("**: "), "presented_sender_type", F.lit(" → "), "reviewed_sender_type"
        ),
        keep=tuple(BATCH),
    )
    note = "> **Safety note:** If this brief conflicts with the JSON manifest, the manifest wins."
    outro = _lines(info, 4, top, "", note, "", keep=tuple(BATCH))
    return _union([intro, senders, heading, corrections, outro])
