"""Checked queries over the given tables, each with oracle SQL where SQL can state it."""

from mailsift.checks import (  # noqa: F401
    io_queries,
    noise_queries,
    raw_queries,
    sender_queries,
    thread_queries,
)
from mailsift.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
