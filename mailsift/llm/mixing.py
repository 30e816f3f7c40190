"""Mixing sources to target weights by Sainte-Laguë apportionment of equal word blocks.

The words of a mix are dealt in blocks of equal size. Each source gets the number of
blocks that Sainte-Laguë's highest quotients give its target; a source's blocks are
dealt to its shards the same way, by their sizes. Inside a shard, documents stand in a
seeded order and the first blocks of that stream are taken, going round up to
``repeats`` times. Only DataFrame functions are used; apart from one pass over the
texts, all rows are a few numbers wide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.common import WORD, staged

# Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
# How often a document may be taken.
REPEATS = 3
# Blocks that the mix is dealt in; small inputs use blocks of one word.
BLOCKS = 1 << 17
# Documents of a shard, on average. A hot source has many shards.
SHARD_ROWS = 4096
SEED = 20_240_601


def word_count(text: Column | str) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Add ``target`` to one row per source with ``source`` and ``source_size``.

    Sources in order of their names, null last, share all words by weight; a share above
    ``repeats`` times the source's size is cut to that and the excess shared again. With
    sources in order of that limit per weight, the level at which shares end is the
    largest of the levels found when the first 0, 1, 2, ... of them are at their limits.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(names) - 1, F.lit(len(weights))) + 1)
    limited = sources.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * repeats)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))) / F.sum(
        "_w"
    ).over(later)
    return (
        limited.withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(everything))
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")))
        .drop("_w", "_cap", "_level")
    )


def apportion(parties: DataFrame, group: Sequence[str], name: str, votes: str, seats: str) -> DataFrame:
    """Add ``won``: the seats of each party among the ``seats`` of its group, by highest quotients.

    A party with v votes has the quotients v/1, v/3, v/5, ...; the highest of a group get
    its seats, ties going to the smaller name. With n seats and m parties, no party is
    further than m/2n of its share plus one from its share, so only quotients around that
    place are ranked: about three rows per party.
    """
    whole = Window.partitionBy(*group)
    counted = parties.withColumn("_all", F.sum(votes).over(whole)).withColumn("_m", F.count(F.lit(1)).over(whole))
    share = F.col(votes) * F.col(seats) / F.col("_all")
    slack = F.col("_m") / (2 * F.col(seats))
    some = (F.col("_all") > 0) & (F.col(seats) > 0)
    placed = counted.withColumn(
        "_low", F.when(some, F.greatest(F.lit(0), F.floor(share * (1 - slack) - 1.5))).otherwise(0).cast("long")
    ).withColumn("_high", F.when(some, F.floor(share * (1 + slack) + 1.5)).otherwise(0).cast("long"))
    placed = placed.withColumn("_open", F.col(seats) - F.sum("_low").over(whole))
    ranked = placed.select(
        *group, name, "_open", votes, F.explode(F.sequence("_low", "_high")).alias("_seat")
    ).withColumn("_quotient", F.col(votes) / (2 * F.col("_seat") + 1))
    order = whole.orderBy(F.desc("_quotient"), F.col(name).asc_nulls_last(), F.col("_seat"))
    more = (
        ranked.filter(F.col(votes) > 0)
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= F.col("_open"))
        .groupBy(*group, name)
        .agg(F.count(F.lit(1)).alias("_more"))
    )
    same = F.lit(True)
    left = placed.alias("l")
    for column in [*group, name]:
        same = same & F.col(f"l.{column}").eqNullSafe(F.col(f"r.{column}"))
    return left.join(more.alias("r"), same, "left").select(
        *[F.col(f"l.{c}") for c in parties.columns],
        (F.col("l._low") + F.coalesce(F.col("r._more"), F.lit(0))).alias("won"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    repeats: int = REPEATS,
    blocks: int = BLOCKS,
    shard_rows: int = SHARD_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """Per document its size in words, its source's size and target, and the words taken.

    Reads doc_id, text and source. Null text has size 0 and is never taken; null sources
    are one source, the last; a null doc_id is carried and placed like any value. Rows
    that repeat are separate documents. An empty table gives an empty result.
    """
    sized = docs.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", "source", word_count("text").alias("size")
    )
    return _mix(staged(sized, "mix-sizes"), weights, repeats, blocks, shard_rows, seed).drop("_row")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: every row as often as its words are taken, to the nearest whole copy.

    At most one document of a shard is taken in part; it counts if half of it is taken.
    """
    rows = staged(
        docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("doc")), "mix-documents"
    )
    sized = staged(
        rows.select("_row", "doc.doc_id", "doc.source", word_count("doc.text").alias("size")), "mix-sizes"
    )
    taken = _mix(sized, **options).filter("taken > 0").select("_row", F.round(F.col("taken") / F.col("size")).alias("copies"))
    copies = taken.filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.join(copies.select("_row"), "_row").select("doc.*")


def _mix(
    sized: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    repeats: int = REPEATS,
    blocks: int = BLOCKS,
    shard_rows: int = SHARD_ROWS,
    seed: int = SEED,
) -> DataFrame:
    sources = targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")),
        weights,
        repeats,
    )
    total = F.sum("source_size").over(Window.partitionBy())
    sources = (
        sources.withColumn("_total", total)
        .withColumn("_block", F.greatest(F.lit(1).cast("long"), F.expr(f"_total div {blocks}")))
        .withColumn("_seats", F.expr("_total div _block"))
    )
    quotas = apportion(sources, [], "source", "target", "_seats").withColumnRenamed("won", "_blocks")
    quotas = staged(
        quotas.withColumn("_shards", F.ceil(F.col("_docs") / shard_rows)).drop("_total", "_seats", "_docs"), "mix-sources"
    )
    placed = (
        sized.alias("d")
        .join(quotas.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")))
        .select(
            "d.doc_id", "d.source", "d.size", "d._row", "q.source_size", "q.target", "q._block", "q._blocks", "q._shards"
        )
        .withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "size"))
        .withColumn("_shard", F.pmod("_hash", "_shards"))
    )
    shards = placed.groupBy("source", "_shard").agg(
        F.sum("size").alias("_shard_size"), F.first("_block").alias("_block"), F.first("_blocks").alias("_blocks")
    )
    won = apportion(shards, ["source"], "_shard", "_shard_size", "_blocks").select(
        F.col("source").alias("_s"),
        F.col("_shard").alias("_p"),
        "_shard_size",
        F.least(F.col("won") * F.col("_block"), F.col("_shard_size") * repeats).alias("_words"),
    )
    stream = Window.partitionBy("source", "_shard").orderBy("_hash", "doc_id", "_row")
    before = F.coalesce(F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rounds = F.when(F.col("_shard_size") > 0, F.expr("_words div _shard_size")).otherwise(0)
    part = F.col("_words") - rounds * F.col("_shard_size") - F.col("_before")
    return (
        placed.withColumn("_before", before)
        .join(won, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_p")))
        .select(
            "_row",
            "doc_id",
            "size",
            "source_size",
            "target",
            (rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), part))).cast("long").alias("taken"),
        )
    )
