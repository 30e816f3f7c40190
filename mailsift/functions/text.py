"""Bodies, model output, previews and error texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsift.functions.address import _col, trim_all

# Fixed patterns. A marker line starts quoted history; a quoted line is dropped alone.
HISTORY_MARKER = (
    r"(?m)^On .+ wrote:\s*$|^From: .*$|^-{6}.*$"
)
QUOTED_LINE = r"(?m)^>+ .*$"
LEGACY_MESSAGE_ID = r"^Message ([^:]+):"
FENCED_JSON = r"(?s)^```(?:json)?\s*\n?(.+?)\n?```\s*\z"


def strip_html(html: Column | str) -> Column:
    """Replace tags by a blank, collapse blanks and tabs, trim."""
    plain = F.regexp_replace(_col(html), r"<[^>]*>", " ")
    return trim_all(F.regexp_replace(plain, r"[ \t]{2,}", " "))


def unique_content(body: Column | str, max_chars: int | None = None) -> Column:
    """The text a message adds: lines before the first history marker, without quoted lines.

    The whole body is read; ``max_chars`` cuts it first, for callers who want a limit.
    """
    body = _col(body)
    if max_chars is not None:
        body = F.substring(body, 1, max_chars)
    lines = F.split(body, "\n", -1)
    marks = F.transform(lines, lambda line: line.rlike(HISTORY_MARKER))
    first = F.array_position(marks, True).cast("int")
    own = F.when(first == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(first - 1, F.lit(0))))
    kept = F.filter(own, lambda line: ~line.rlike(QUOTED_LINE))
    return F.array_join(kept, "\n")


def legacy_message_id(text: Column | str) -> Column:
    """Message id inside a free-text error, else NULL."""
    return F.nullif(F.regexp_extract(_col(text), LEGACY_MESSAGE_ID, 1), F.lit(""))


def json_payload(text: Column | str) -> Column:
    """JSON inside model output: the fenced block, or the text itself if it starts like JSON."""
    text = trim_all(text)
    fenced = F.regexp_extract(text, FENCED_JSON, 1)
    return F.when(fenced != "", trim_all(fenced)).when(
        text.startswith("{") | text.startswith("["), text
    )


def preview(text: Column | str, n: int = 500) -> Column:
    """The first ``n`` characters, for display."""
    return F.substring(_col(text), 1, n)


def decode_body(data: Column | str) -> Column:
    """Text of a base64url body; malformed bytes become U+FFFD."""
    raw = F.unbase64(F.translate(_col(data), "-_", "+/"))
    return F.make_valid_utf8(raw.cast("string"))
