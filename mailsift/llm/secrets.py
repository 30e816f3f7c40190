"""Secret scans with corpus-wide ownership frequency.

Patterns find candidate values in every text. The hash of each value is then counted
over the corpus by distinct documents (the repositories) and distinct sources (their
owners): a value that several owners carry is a copied example, a value of one owner is
taken for a live credential. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import staged

# The base patterns, their kinds in order, and the least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "value")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

# Long runs that hold letters and digits are candidates besides the base kinds.
VALUE = r"[A-Za-z0-9+/_=-]{20,}"
# Owners from which on a value counts as an example that is copied about.
EXAMPLE_OWNERS = 3
# So is a value in this many documents for each source that carries it: a template, not a credential.
EXAMPLE_DOCUMENTS = 1000
# Matches whose positions are summed up together.
BLOCK = 512
PLACEHOLDER = "[secret]"


def running_ends(lengths: Column) -> Column:
    """Running totals of an array of integers, in blocks, so that cost stays near linear."""
    zero = F.lit(0).cast("long")
    blocks = F.when(
        F.size(lengths) > 0,
        F.transform(
            F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
            lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)),
        ),
    ).otherwise(F.array().cast("array<array<bigint>>"))

    def totals(values: Column, add) -> Column:
        start = F.struct(zero.alias("sum"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            values,
            start,
            lambda a, x: F.struct(
                (a["sum"] + add(x)).alias("sum"), F.concat(a["out"], F.array(a["sum"] + add(x))).alias("out")
            ),
            lambda a: a["out"],
        )

    sums = totals(blocks, lambda b: F.aggregate(b, zero, lambda s, x: s + x))
    return F.flatten(
        F.zip_with(
            blocks,
            sums,
            lambda b, s: F.transform(
                totals(b, lambda x: x), lambda e: e + s - F.aggregate(b, zero, lambda t, x: t + x)
            ),
        )
    )


def matches(text: Column, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """Spans of a pattern: start and end in code points, the kind's number and the value.

    The matches are leftmost and do not overlap; those whose group is shorter than
    ``least`` are dropped. A text's matches and the gaps between them, in turn, make up
    the text, which gives the positions.
    """
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    ends = running_ends(
        F.zip_with(gaps, whole, lambda g, m: (F.char_length(g) + F.char_length(m)).cast("long"))
    )
    zipped = F.zip_with(
        F.zip_with(whole, values, lambda m, v: F.struct(F.char_length(m).cast("long").alias("n"), v.alias("value"))),
        ends,
        lambda m, end: F.struct(
            (end - m["n"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["value"].alias("value")
        ),
    )
    return F.when(
        F.size(whole) > 0, F.filter(zipped, lambda m: F.char_length(m["value"]) >= least)
    ).otherwise(empty)


def candidates(text: Column) -> Column:
    """All spans of a text, base kinds first, each with the hash of its value."""
    value = F.filter(
        matches(text, VALUE, 3, 20), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]")
    )
    found = F.concat(
        matches(text, ASSIGN, 0, ASSIGN_LEAST, group=2),
        matches(text, ACCESS, 1, ACCESS_LEAST),
        matches(text, HEX, 2, 32),
        value,
    )
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), F.md5(m["value"]).alias("value")
        ),
    )


def ownership(found: DataFrame) -> DataFrame:
    """Distinct documents and owners of every value; input one row per span."""
    by_owner = found.groupBy("value", "source").agg(F.count(F.lit(1)).alias("documents"))
    return by_owner.groupBy("value").agg(
        F.sum("documents").alias("documents"), F.count(F.lit(1)).alias("owners")
    )


def scan(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_documents: int = EXAMPLE_DOCUMENTS) -> DataFrame:
    """``doc``, the row as a struct, and ``spans``: all base spans, and the other spans of live-looking values.

    A span has start, kind (a place in KINDS), end, and live: whether fewer than
    ``example_owners`` distinct sources carry the value, and these in fewer than
    ``example_documents`` documents each on average. A null source is one owner.
    Null and empty texts have no spans; repeated rows are scanned one by one and count as
    documents of their own. Further columns are carried in the struct, whatever their names.
    """
    rows = staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.struct("*").alias("doc"),
            candidates(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("found"),
        ),
        "secret-spans",
    )
    held = rows.filter(F.size("found") > 0)
    found = held.select("row", F.col("doc.source").alias("source"), F.explode("found").alias("m"))
    found = found.select("row", "source", "m.*")
    owners = ownership(found.dropDuplicates(["row", "value"]))
    judged = (
        found.join(owners, "value")
        .withColumn("live", (F.col("owners") < example_owners) & (F.col("documents") < example_documents * F.col("owners")))
        .filter(F.col("live") | (F.col("kind") < KINDS.index("value")))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("spans"))
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean>>")
    plain = rows.filter(F.size("found") == 0).select("doc", none.alias("spans"))
    return plain.unionByName(
        held.join(judged, "row", "left").select("doc", F.coalesce("spans", none).alias("spans"))
    )


def spelled(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and digest of the spans of a scanned table."""
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("value"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc.doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(spelled(base), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def redact(scanned: DataFrame) -> DataFrame:
    """The scanned documents, their live secrets replaced; n_chars follows the new text."""
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    hidden = F.aggregate(
        F.filter("spans", lambda s: s["live"]),
        start,
        lambda a, s: F.struct(
            F.when(
                s["start"] >= a["at"],
                F.concat(
                    a["out"],
                    F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                    F.lit(PLACEHOLDER),
                ),
            )
            .otherwise(a["out"])
            .alias("out"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    live = F.exists("spans", lambda s: s["live"])
    changed = scanned.withColumn("text", F.when(live, hidden).otherwise(F.col("doc.text")))
    chars = F.when(live, F.char_length("text").cast("long")).otherwise(F.col("doc.n_chars"))
    columns = scanned.schema["doc"].dataType.names
    replaced = {"text": F.col("text"), "n_chars": chars}
    return changed.select(*[replaced.get(c, F.col(f"doc.`{c}`")).alias(c) for c in columns])
