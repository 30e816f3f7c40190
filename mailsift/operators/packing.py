"""Greedy packing of senders into OR queries, exact and without a serial pass over the list.

Packing is sequential: where a query starts depends on all earlier ones. Two facts make
it a distributed job. A query holds a bounded number of senders, so a query that is open
at a block border started a bounded number of places before it; and where packing leaves
a block depends only on where it enters. So each block of the sorted list first maps
every possible entry to its exit, the small maps are combined in groups of FAN, level by
level, and each block is packed from its now known entry. No task holds all blocks of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.ranking import hot_keys, number_by_order
from mailsift.session import durable

# Fixed values of the query text.
CLAUSE = "from:"
SEPARATOR = " OR "
MAX_CHARS = 1200

# Senders of one group that a task packs at a time, and blocks whose maps a task combines.
BLOCK = 100_000
FAN = 256


def _next_starts(lengths: np.ndarray, budget: int, max_items: int | None) -> np.ndarray:
    """For each position, where the next query starts if one starts here."""
    ends = np.concatenate(([0], np.cumsum(lengths + len(SEPARATOR))))
    at = np.arange(len(lengths))
    following = np.searchsorted(ends, ends[:-1] + budget + len(SEPARATOR), side="right") - 1
    following = np.maximum(following, at + 1)
    if max_items is not None:
        following = np.minimum(following, at + max_items)
    return following


def pack_or_queries(
    senders: DataFrame,
    group: Sequence[str] = (),
    order: Sequence[Column | str] = ("sender",),
    max_chars: int = MAX_CHARS,
    max_items: int | None = None,
    wrap: tuple[str, str] = ("", ""),
    block: int = BLOCK,
    fan: int = FAN,
) -> DataFrame:
    """Pack column ``sender`` into queries ``from:a OR from:b`` per group, in ``order``.

    A query never exceeds ``max_chars`` (wrapper included), unless one sender alone does,
    nor ``max_items`` senders. Returns (group, batch_no from 0, senders, query).
    """
    if max_chars <= 0 or (max_items is not None and max_items <= 0):
        raise ValueError("max_chars and max_items must be positive")
    keys = list(group) or ["_all"]
    listed = senders if group else senders.withColumn("_all", F.lit(0))
    budget = max_chars - len(wrap[0]) - len(wrap[1])
    # No query can hold more senders than this, as every clause costs at least its own text.
    longest = max(1, max_chars // (len(CLAUSE) + len(SEPARATOR)) + 1)
    if max_items is not None:
        longest = min(longest, max_items)
    block = max(block, 2 * longest)

    short = hot_keys(listed.select(*keys), keys, block) is None
    if short:
        window = Window.partitionBy(*keys).orderBy(*order)
        placed = listed.withColumn("_pos", F.row_number().over(window).cast("bigint") - 1)
    else:
        placed = number_by_order(listed, keys, list(order), "_pos").withColumn("_pos", F.col("_pos") - 1)
    placed = placed.select(*keys, "sender", "_pos", F.expr(f"_pos div {block}").alias("_block"))
    placed = placed.withColumn("_len", F.length("sender") + F.lit(len(CLAUSE)))
    if short:  # every group is one block, entered at its first place
        entries = placed.select(*keys).distinct().withColumns({c: F.lit(0).cast("long") for c in ("_block", "_entry", "_batch")})
    else:
        entries = _entries(placed, keys, block, longest, budget, max_items, fan)
    packed = _assign(placed, entries, keys, budget, max_items)

    rows = packed.groupBy(*keys, "batch_no").agg(F.array_sort(F.collect_list(F.struct("_pos", "sender"))).alias("_s"))
    clauses = F.transform(F.col("_s.sender"), lambda s: F.concat(F.lit(CLAUSE), s))
    query = F.concat(F.lit(wrap[0]), F.array_join(clauses, SEPARATOR), F.lit(wrap[1]))
    return rows.select(*group, "batch_no", F.col("_s.sender").alias("senders"), query.alias("query"))


def _entries(
    placed: DataFrame, keys: list[str], block: int, longest: int, budget: int, max_items: int | None, fan: int
) -> DataFrame:
    """Where packing enters each block and the number of its first query there."""
    # The first places of a block are also shown to the block before, as its look-ahead.
    ahead = (F.col("_block") > 0) & (F.col("_pos") % block < longest)
    blocks = F.when(ahead, F.array("_block", F.col("_block") - 1)).otherwise(F.array("_block"))
    shared = placed.select(*keys, "_pos", "_len", F.explode(blocks).alias("_block"))
    key_fields = [placed.schema[k] for k in keys]
    long = T.LongType()

    def hops(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_pos")
        number = int(part["_block"].iloc[0])
        first = number * block
        size = int((part["_pos"] < first + block).sum())
        following = _next_starts(part["_len"].to_numpy(), budget, max_items)
        leave, count = following.copy(), np.ones(len(following), dtype=np.int64)
        for i in range(size - 1, -1, -1):
            if following[i] < size:
                leave[i] = leave[following[i]]
                count[i] = count[following[i]] + 1
        n = min(longest, size)
        out = pd.DataFrame({k: part[k].iloc[0] for k in keys}, index=range(n))
        return out.assign(
            _block=number, _entry=np.arange(n), _leave=leave[:n] - size, _count=count[:n]
        )

    hop_schema = T.StructType(key_fields + [T.StructField(c, long) for c in ("_block", "_entry", "_leave", "_count")])
    hopped = durable(shared.groupBy(*keys, "_block").applyInPandas(hops, hop_schema), "hops")
    return _chained(hopped, keys, fan)


def _maps(part: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(block, exits, counts) of consecutive blocks, each by entry."""
    sorted_part = part.sort_values(["_block", "_entry"])
    return [(number, t["_leave"].to_numpy(), t["_count"].to_numpy()) for number, t in sorted_part.groupby("_block")]


def _chained(hopped: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """Entry and first query number of each block, from the blocks' maps.

    Maps of ``fan`` blocks are combined into one until a group has no more than ``fan`` of them;
    then each combined map's entry is passed down to the blocks it stands for.
    """
    key_fields = [hopped.schema[k] for k in keys]
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]

    def combine(part: pd.DataFrame) -> pd.DataFrame:
        maps = _maps(part)
        at = np.arange(len(maps[0][1]))
        count = np.zeros(len(at), dtype=np.int64)
        for _, leave, n in maps:
            inside = at < len(leave)  # beyond the last block's end, nothing follows
            count[inside] += n[at[inside]]
            at = np.where(inside, leave[np.minimum(at, len(leave) - 1)], at)
        out = pd.DataFrame({k: part[k].iloc[0] for k in keys}, index=range(len(at)))
        return out.assign(_block=maps[0][0] // fan, _entry=np.arange(len(at)), _leave=at, _count=count)

    def tell(part: pd.DataFrame) -> pd.DataFrame:
        rows, entry, batch = [], int(part["_start"].iloc[0]), int(part["_batch"].iloc[0])
        for number, leave, count in _maps(part):
            rows.append((number, entry, batch))
            if entry >= len(leave):  # the last query reaches past the end of the list
                break
            batch += int(count[entry])
            entry = int(leave[entry])
        out = pd.DataFrame(rows, columns=["_block", "_entry", "_batch"])
        for k in keys:
            out[k] = part[k].iloc[0]
        return out[[*keys, "_block", "_entry", "_batch"]]

    levels = [hopped]
    while (levels[-1].agg(F.max("_block")).first()[0] or 0) >= fan:
        schema = T.StructType(key_fields + longs("_block", "_entry", "_leave", "_count"))
        combined = levels[-1].groupBy(*keys, F.expr(f"_block div {fan}").alias("_part")).applyInPandas(combine, schema)
        levels.append(durable(combined, "hops"))
    zero = F.lit(0).cast("long")
    told = levels[-1].select(*keys).distinct().withColumns({"_part": zero, "_start": zero, "_batch": zero})
    for level in reversed(levels):
        met = level.withColumn("_part", F.expr(f"_block div {fan}")).join(told, [*keys, "_part"])
        schema = T.StructType(key_fields + longs("_block", "_entry", "_batch"))
        entries = met.groupBy(*keys, "_part").applyInPandas(tell, schema)
        told = entries.withColumnsRenamed({"_block": "_part", "_entry": "_start"})
    return entries


def _assign(
    placed: DataFrame, entries: DataFrame, keys: list[str], budget: int, max_items: int | None
) -> DataFrame:
    """Number the query of every sender."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_pos")
        following = _next_starts(part["_len"].to_numpy(), budget, max_items)
        starts = np.zeros(len(part), dtype=np.int64)
        at = int(part["_entry"].iloc[0])
        while at < len(part):
            starts[at] = 1
            at = int(following[at])
        number = part["_batch"].iloc[0] - 1 + np.cumsum(starts)
        return part[[*keys, "sender", "_pos"]].assign(batch_no=number)

    schema = T.StructType(
        [placed.schema[k] for k in keys]
        + [placed.schema["sender"], T.StructField("_pos", T.LongType()), T.StructField("batch_no", T.LongType())]
    )
    joined = placed.join(entries, [*keys, "_block"])
    return joined.groupBy(*keys, "_block").applyInPandas(pack, schema)
