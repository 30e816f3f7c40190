"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

Leaves are sentences (longer runs are cut every 100 code points), their parents
paragraphs, then sections, then the root. Roots are equal exactly for equal texts; where
roots differ, the hashes of sections and paragraphs say where. The likeness of two trees
is the share of code points in leaves that both hold; it comes from the trees' leaves, not
from their roots. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.common import staged

# Borders of sections and paragraphs, and the leaves; in a row, leaves make up the text.
SECTION = r"(?<=\n\n)(?!\n)"
PARAGRAPH = r"(?<=\n)(?!\n)"
LEAF = r"[^.!?\n]{0,100}+[.!?\n]++[\x20\t]*+|[^.!?\n]{1,100}+"
# Ids that share a window. Every key is split by this again and again to find the id
# that follows the last one of a window.
SPAN_BITS = 10
LEVELS = 6


def paragraph_hashes(text: Column) -> Column:
    """Hashes of the paragraphs, by section."""

    def paragraph(p: Column) -> Column:
        leaves = F.regexp_extract_all(p, F.lit(LEAF), F.lit(0))
        return F.sha2(F.concat(F.lit("p"), F.array_join(F.transform(leaves, lambda s: F.sha2(s, 256)), "")), 256)

    sections = F.filter(F.split(text, SECTION, -1), lambda s: F.char_length(s) > 0)
    return F.transform(
        sections,
        lambda s: F.transform(F.filter(F.split(s, PARAGRAPH, -1), lambda p: F.char_length(p) > 0), paragraph),
    )


def section_hashes(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda s: F.sha2(F.concat(F.lit("s"), F.array_join(s, "")), 256))


def root(paragraphs: Column) -> Column:
    """The fingerprint: the hash of the section hashes."""
    return F.sha2(F.concat(F.lit("r"), F.array_join(section_hashes(paragraphs), "")), 256)


def leaves(text: Column) -> Column:
    """Distinct leaves as one long each: 56 bits of a hash and 8 of the length."""
    found = F.regexp_extract_all(text, F.lit(LEAF), F.lit(0))
    return F.array_distinct(
        F.transform(
            found,
            lambda s: F.shiftleft(F.xxhash64(s), 8).bitwiseOR(
                F.least(F.char_length(s), F.lit(255)).cast("long")
            ),
        )
    )


def likeness(a: Column, b: Column) -> Column:
    """Twice the length of common leaves over the length of all; 1 for two empty trees."""
    size = lambda x: F.aggregate(
        x, F.lit(0).cast("long"), lambda s, v: s + v.bitwiseAND(F.lit(255).cast("long"))
    )
    whole = size(a) + size(b)
    return F.when(whole > 0, 2.0 * size(F.array_intersect(a, b)) / whole).otherwise(1.0)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ends(a: Column, b: Column) -> Column:
    """How many children two nodes share at their beginnings, and at their ends in what is left."""
    least = F.least(F.size(a), F.size(b))
    steps = F.slice(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), F.lit(1), least)

    def run(same) -> Column:
        other = F.array_position(F.transform(steps, same), F.lit(False)).cast("int")
        return F.when(other > 0, other - 1).otherwise(least)

    lead = run(lambda i: F.get(a, i - 1) == F.get(b, i - 1))
    tail = run(lambda i: F.get(a, F.size(a) - i) == F.get(b, F.size(b) - i))
    return _let(lead, lambda n: F.struct(n.alias("lead"), F.least(tail, least - n).alias("tail")))


def _inner(x: Column, ends: Column) -> Column:
    return F.slice(x, ends["lead"] + 1, F.size(x) - ends["lead"] - ends["tail"])


def differing(a: Column, b: Column) -> Column:
    """Section and paragraph numbers, from 0, in tree ``b`` of what tree ``a`` does not hold there.

    With the trees exchanged it tells what was removed. Sections that both trees begin or end
    with are not looked into, nor are paragraphs that the sections between begin or end with.
    Of the paragraphs left, each is matched with the next equal one of ``a``, in order, so
    what was put in shifts nothing, and a moved paragraph shows at its new or its old place.
    Empty in both directions exactly for equal trees.
    """
    place = "array<struct<section:int,paragraph:int>>"
    places = lambda x: F.transform(x, lambda p: F.struct(p["section"], p["paragraph"]))

    def paragraphs(t: Column, ends: Column) -> Column:
        return F.struct(
            F.flatten(_inner(t["a"], ends)).alias("a"),
            F.flatten(
                F.transform(
                    _inner(t["b"], ends),
                    lambda s, i: F.transform(
                        s,
                        lambda h, j: F.struct((ends["lead"] + i).alias("section"), j.alias("paragraph"), h.alias("hash")),
                    ),
                )
            ).alias("b"),
        )

    def step(state: Column, p: Column) -> Column:
        found = F.array_position(state["rest"], p["hash"]).cast("int")
        after = F.slice(state["rest"], found + 1, F.size(state["rest"]))
        here = F.struct(p["section"].alias("section"), p["paragraph"].alias("paragraph"))
        return F.when(found > 0, F.struct(after.alias("rest"), state["out"].alias("out"))).otherwise(
            F.struct(state["rest"].alias("rest"), F.array_append(state["out"], here).alias("out"))
        )

    def unmatched(rest: Column, own: Column) -> Column:
        start = F.struct(rest.alias("rest"), F.array().cast(place).alias("out"))
        walked = F.aggregate(own, start, step, lambda state: state["out"])
        apart = F.size(F.array_intersect(rest, own["hash"])) == 0
        return F.when(apart, places(own).cast(place)).otherwise(walked)

    def inside(t: Column) -> Column:
        ends = _ends(t["a"], t["b"]["hash"])
        return _let(ends, lambda e: unmatched(_inner(t["a"], e), _inner(t["b"], e)))

    trees = F.struct(a.alias("a"), b.alias("b"))
    return _let(trees, lambda t: _let(_ends(t["a"], t["b"]), lambda e: _let(paragraphs(t, e), inside)))


def following(keys: DataFrame, level: int = 0) -> DataFrame:
    """For distinct non-null bigints ``k``, the next larger one; null for the last.

    Keys that agree but for their last bits share a window; the key after the last one of
    a window is the first of the next window, which is found the same way. At the top
    there are few keys, as they have lost all but their first bits.
    """
    if level == LEVELS:
        return keys.select("k", F.lead("k").over(Window.orderBy("k")).alias("after"))
    grouped = keys.withColumn("g", F.shiftright("k", SPAN_BITS))
    first = grouped.groupBy("g").agg(F.min("k").alias("first"))
    after = following(first.select(F.col("g").alias("k")), level + 1)
    entry = after.join(first.select(F.col("g").alias("after"), "first"), "after").select(
        F.col("k").alias("g"), "first"
    )
    inside = grouped.withColumn("after", F.lead("k").over(Window.partitionBy("g").orderBy("k")))
    return inside.join(entry, "g", "left").select("k", F.coalesce("after", "first").alias("after"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, and next_text: the text of the next document, that of the last being the first.

    Order is by doc_id, then text. Texts are shuffled once: documents of nearby ids share
    a window, and the first document of each window also goes, as a guest, into the window before.
    Documents without an id lie scattered, and each is its own next.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    ids = rows.select("doc_id").dropna().withColumn("g", F.shiftright("doc_id", SPAN_BITS))
    first = staged(ids.groupBy("g").agg(F.min("doc_id").alias("first")), "merkle-windows")
    after = following(first.select(F.col("g").alias("k")))
    ends = first.agg(F.min("g").alias("low"), F.max("g").alias("high"))
    nexts = after.crossJoin(F.broadcast(ends)).select(
        F.col("k").alias("home"), F.coalesce("after", "low").alias("g")
    )
    guests = staged(nexts.join(first, "g").select(F.col("first").alias("guest_id"), "home"), "merkle-guests")
    placed = rows.join(guests, F.col("doc_id") == F.col("guest_id"), "left").select(
        "doc_id",
        "text",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(
                        F.coalesce(F.shiftright("doc_id", SPAN_BITS), F.xxhash64("text")).alias("g"),
                        F.lit(False).alias("guest"),
                    ),
                    F.when(F.col("home").isNotNull(), F.struct(F.col("home").alias("g"), F.lit(True).alias("guest"))),
                )
            )
        ).alias("at"),
    )
    window = Window.partitionBy("at.g").orderBy("at.guest", "doc_id", "text")
    return (
        placed.withColumn("next_text", F.when(F.col("doc_id").isNotNull(), F.lead("text").over(window)))
        .filter(~F.col("at.guest"))
        .select("doc_id", "text", F.coalesce("next_text", "text").alias("next_text"))
    )


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses.

    Null text counts as empty. A document without an id has no place in the order and is
    its own next. Rows that repeat an id follow one another by text. ``changed_paragraphs``
    counts the paragraphs of the edited text that the text does not hold in their places.
    Only doc_id and text are read.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)
    )
    rows = (
        with_next(docs)
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", edited)
        .withColumn("tree", paragraph_hashes(F.col("text")))
        .withColumn("edited_tree", paragraph_hashes(F.col("edited")))
        .withColumn("own", leaves(F.col("text")))
    )
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        root(F.col("tree")).alias("fingerprint"),
        root(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("own"), leaves(F.col("edited"))).alias("near_edited"),
        likeness(F.col("own"), leaves(F.col("next_text"))).alias("near_next"),
        F.size(differing(F.col("tree"), F.col("edited_tree"))).alias("changed_paragraphs"),
    )
