"""Dates, ratios and display formats."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsift.functions.address import _col

# Days after which a thread no longer counts as actionable.
ACTIONABLE_DAYS = 365


def at(moment: Column | str | datetime) -> Column:
    """A fixed point in time; the engine never reads the wall clock."""
    if isinstance(moment, Column):
        return moment
    if isinstance(moment, datetime):
        moment = moment.isoformat(sep=" ")
    return F.lit(moment).cast("timestamp_ntz")


def arrival_order(date: Column | str, seq: Column | str) -> Column:
    """(date, sequence) as one fixed-width number.

    Aggregates over fixed-width values keep the hash path; a struct would force a sort.
    """
    micros = F.unix_micros(_col(date).cast("timestamp")).cast("decimal(19,0)")
    wide = (micros * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)")
    return wide + _col(seq).cast("decimal(18,0)")


def ymd(date: Column | str) -> Column:
    return F.date_format(_col(date), "yyyy-MM-dd")


def query_date(date: Column | str) -> Column:
    return F.date_format(_col(date), "yyyy/MM/dd")


def iso_instant(date: Column | str) -> Column:
    return F.date_format(_col(date), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def whole_percent(ratio: Column | str) -> Column:
    """Ratio as an integer percent, halves up."""
    return F.floor(_col(ratio) * F.lit(100.0) + F.lit(0.5))


def two_decimals(ratio: Column | str) -> Column:
    return F.floor(_col(ratio) * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def thousands(n: Column | str) -> Column:
    return F.format_number(_col(n), 0)


def within_days(date: Column | str, as_of, days: int = ACTIONABLE_DAYS) -> Column:
    """True when ``date`` is at most ``days`` days before ``as_of``."""
    return _col(date) >= at(as_of) - F.expr(f"INTERVAL {days} DAYS")
