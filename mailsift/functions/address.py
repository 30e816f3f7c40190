"""Sender keys, domains and mail headers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of header parsing.
BRACKETED = r"^(.*?)\s*<(.+?)>\z"
# Accepted e-mail syntax: local part (dotted atoms or quoted), then an address literal or a domain.
EMAIL_SYNTAX = (
    r'^(([^<>()\[\]\\.,;:\s@"]+(\.[^<>()\[\]\\.,;:\s@"]+)*)|(".+"))'
    r"@((\[[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\])|(([a-zA-Z\-0-9]+\.)+[a-zA-Z]{2,}))$"
)

# The characters that trimming removes.
WHITE_SPACE = (
    "\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Mailbox tab labels and the category each one stands for.
CATEGORY_LABELS = {
    "CATEGORY_PERSONAL": "primary",
    "CATEGORY_SOCIAL": "social",
    "CATEGORY_PROMOTIONS": "promotions",
    "CATEGORY_UPDATES": "updates",
    "CATEGORY_FORUMS": "forums",
}

NO_SUBJECT = "(no subject)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(c: Column | str) -> Column:
    """Trim every Unicode white space and U+FEFF, not only blanks."""
    return F.btrim(_col(c), F.lit(WHITE_SPACE))


def sender_key(email: Column | str) -> Column:
    """Key of statistics: lower case only."""
    return F.lower(_col(email))


def decision_key(email: Column | str) -> Column:
    """Key of decisions and rules: trimmed, then lower case."""
    return F.lower(trim_all(email))


def domain(email: Column | str) -> Column:
    """Lower-cased text after the first ``@``; empty when there is none."""
    email = _col(email)
    at = F.instr(email, "@")
    return F.when(at == 0, F.lit("")).otherwise(F.lower(F.substr(email, at + 1)))


def local_part(email: Column | str) -> Column:
    """Lower-cased text before the first ``@``; the whole text when there is none."""
    return F.lower(F.substring_index(_col(email), "@", 1))


def in_domains(name: Column, domains: Iterable[str]) -> Column:
    """True when ``name`` is one of ``domains`` or a subdomain of one."""
    return reduce(lambda a, b: a | b, [(name == d) | name.endswith("." + d) for d in domains])


def header(headers: Column | str, name: str) -> Column:
    """Value of the first header with this name (any case) and a value."""
    wanted = name.lower()
    found = F.filter(_col(headers), lambda h: (F.lower(h["name"]) == wanted) & h["value"].isNotNull())
    return F.try_element_at(found, F.lit(1))["value"]


def _is_bracketed(value: Column) -> Column:
    """True for ``name <address>``; the cheap test on the last character comes first."""
    return value.endswith(">") & value.rlike(BRACKETED)


def _unquoted(name: Column) -> Column:
    name = trim_all(name)
    quoted = name.startswith('"') & name.endswith('"') & (F.length(name) >= 2)
    return F.when(quoted, F.substr(name, F.lit(2), F.length(name) - 2)).otherwise(name)


def from_header(raw: Column | str, max_chars: int | None = None) -> Column:
    """Split a ``From`` value into ``struct<email, name>``.

    Accepts ``Name <addr>``, ``"Quoted" <addr>``, ``<addr>`` and a bare address. The
    whole value is read; ``max_chars`` cuts it first, for callers who want a limit.
    """
    value = trim_all(raw)
    if max_chars is not None:
        value = F.substring(value, 1, max_chars)
    bracketed = _is_bracketed(value)
    email = F.when(bracketed, trim_all(F.regexp_extract(value, BRACKETED, 2))).otherwise(trim_all(value))
    name = F.when(bracketed, _unquoted(F.regexp_extract(value, BRACKETED, 1))).otherwise(F.lit(""))
    return F.struct(email.alias("email"), name.alias("name"))


def address_list(raw: Column | str, max_chars: int | None = None) -> Column:
    """Addresses of a ``To`` or ``Cc`` value, split on commas outside double quotes.

    The text between quotes is every second piece of a split on the quote sign, so
    commas are marked in the other pieces only; an open quote reaches to the end.
    """
    value = trim_all(raw)
    if max_chars is not None:
        value = F.substring(value, 1, max_chars)
    pieces = F.transform(
        F.split(value, '"', -1),
        lambda piece, i: F.when(i % 2 == 0, F.translate(piece, ",", "\u0001")).otherwise(piece),
    )
    entries = F.transform(F.split(F.array_join(pieces, '"'), "\u0001", -1), trim_all)
    addresses = F.transform(
        entries,
        lambda e: F.when(_is_bracketed(e), trim_all(F.regexp_extract(e, BRACKETED, 2))).otherwise(e),
    )
    return F.coalesce(F.filter(addresses, lambda a: a != ""), F.array().cast("array<string>"))


def infer_category(labels: Column | str) -> Column:
    """Category of the first mailbox tab label, else ``unknown``."""
    names = F.create_map(*[F.lit(x) for pair in CATEGORY_LABELS.items() for x in pair])
    known = F.filter(F.transform(_col(labels), lambda label: F.try_element_at(names, label)), lambda c: c.isNotNull())
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.lit("unknown"))


def is_email(c: Column | str) -> Column:
    """True for text that has the accepted e-mail syntax."""
    return F.coalesce(_col(c).rlike(EMAIL_SYNTAX), F.lit(False))
