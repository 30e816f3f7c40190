"""Folder trees (id, parent_id, display_name, total_items)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.session import durable

# System folders that are left out.
EXCLUDED_FOLDERS = [
    "Drafts",
    "Sent Items",
    "Deleted Items",
    "Junk Email",
    "Outbox",
    "Conversation History",
    "Sync Issues",
]


def excluded_roots(folders: DataFrame, well_known: DataFrame | None = None) -> DataFrame:
    """Folders excluded by display name or by well-known id."""
    roots = folders.filter(F.col("display_name").isin(EXCLUDED_FOLDERS)).select("id")
    return roots if well_known is None else roots.unionByName(well_known.select("id"))


def folder_closure(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """``roots`` and all folders below them.

    One join per level of the tree, with each level written out; a level never meets
    folders already found, so the loop also ends on a cyclic tree.
    """
    edges = folders.select("id", F.col("parent_id"))
    level = durable(roots.select("id").distinct(), "folders")
    found = level
    while not level.isEmpty():
        below = edges.join(level.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id").distinct()
        level = durable(below.join(found, "id", "left_anti"), "folders")
        found = found.unionByName(level)
    return found


def drop_excluded_folders(raw: DataFrame, folders: DataFrame, well_known: DataFrame | None = None) -> DataFrame:
    """Raw messages outside the excluded folders and everything below them.

    ``well_known`` lists ids of system folders, whose display names may be in any language.
    """
    closed = folder_closure(folders, excluded_roots(folders, well_known)).select(F.col("id").alias("parentFolderId"))
    return raw.join(closed, "parentFolderId", "left_anti")


def folder_estimate(folders: DataFrame, excluded: DataFrame) -> DataFrame:
    """Items outside the excluded folders: one row."""
    kept = folders.join(excluded.select("id"), "id", "left_anti")
    return kept.agg(F.coalesce(F.sum("total_items"), F.lit(0)).alias("estimate"))
