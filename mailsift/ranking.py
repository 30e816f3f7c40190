"""Row numbers, chunks and part numbers that never put a whole group in one task.

``row_number()`` over a hot group sends that group to one task. The helpers here sort by
range instead, write the sorted table down, and add the sizes of the partitions before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.session import durable


def number_by_sequence(df: DataFrame, group: Sequence[str], seq: str, out: str) -> DataFrame:
    """Number rows 1..n in each group by a unique column."""
    return number_by_order(df, group, [seq], out)


def number_by_order(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], out: str
) -> DataFrame:
    """Number rows 1..n in each group by any order that has no ties.

    One range shuffle sorts the table and the sorted table is written to the shared
    folder. What comes before a partition is added from one row per group and partition:
    without groups, these rows are as many as partitions and go through the driver; with
    groups, a window runs over them.
    """
    group = list(group)
    placed = (
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = durable(placed, "ranked")
    sizes = placed.groupBy(*group, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")
    )
    if group:
        earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
        starts = sizes.select(*group, "_part", "_first", before.alias("_before"))
    else:
        parts, total = [], 0
        for r in sorted(sizes.collect()):
            parts.append((r["_part"], r["_first"], total))
            total += r["_n"]
        starts = df.sparkSession.createDataFrame(parts, "_part int, _first long, _before long")
    return (
        placed.join(starts, [*group, "_part"])
        .withColumn(out, F.col("_before") + F.col("_at") - F.col("_first") + F.lit(1))
        .drop("_part", "_at", "_first", "_before")
    )


def running_total(df: DataFrame, order: Sequence[str], n: str, out: str) -> DataFrame:
    """The sum of ``n`` over the rows before each row, in an order that has no ties; like ``number_by_order``."""
    placed = durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "totals")
    parts, total = [], 0
    for r in sorted(placed.groupBy("_part").agg(F.sum(n).alias("_n")).collect()):
        parts.append((r["_part"], total))
        total += r["_n"]
    starts = df.sparkSession.createDataFrame(parts, "_part int, _before long")
    earlier = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_inside", F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    return placed.join(starts, "_part").withColumn(out, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")


def chunk(df: DataFrame, group: Sequence[str], seq: str, size: int, out: str = "chunk_no") -> DataFrame:
    """Number each row's chunk 0, 1, ... so that a chunk holds at most ``size`` rows of a group."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    numbered = number_by_sequence(df, group, seq, "_rn")
    return numbered.withColumn(out, F.expr(f"(_rn - 1) div {size}")).drop("_rn")


def last_wins(df: DataFrame, key: Sequence[Column | str], seq: str) -> DataFrame:
    """Keep the row with the highest ``seq`` per key, as a partial aggregate."""
    return _pick(df, key, F.max_by, F.col(seq))


def first_wins(df: DataFrame, key: Sequence[Column | str], seq: str) -> DataFrame:
    """Keep the row with the lowest ``seq`` per key, as a partial aggregate."""
    return _pick(df, key, F.min_by, F.col(seq))


def latest_wins(df: DataFrame, key: Sequence[Column | str], moment: str, seq: str) -> DataFrame:
    """Keep the row with the latest ``moment`` per key; of equals, the first by ``seq``."""
    return _pick(df, key, F.max_by, F.struct(F.col(moment), -F.col(seq)))


def _pick(df: DataFrame, key: Sequence[Column | str], choose, order: Column) -> DataFrame:
    keys = [F.col(k) if isinstance(k, str) else k for k in key]
    row = F.struct(*[F.col(c) for c in df.columns])
    names = [f"_key{i}" for i in range(len(keys))]
    picked = df.groupBy(*[k.alias(n) for k, n in zip(keys, names)]).agg(choose(row, order).alias("_row"))
    return picked.select("_row.*")


def hot_keys(df: DataFrame, key: str | Sequence[str], bound: int) -> DataFrame | None:
    """Keys with more than ``bound`` rows, or None when a check finds none.

    The usual answer is None and costs one map-side reduced count. Found keys are written
    down, since several joins use them; the small table also tells the planner its size.
    """
    keys = [key] if isinstance(key, str) else list(key)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bound).drop("_n")
    return None if hot.isEmpty() else durable(hot, "hot-keys")


def computed_once(df: DataFrame) -> DataFrame:
    """The same table, with a border that filters on its columns do not cross.

    A filter is pushed through a projection by copying the column's expression into it;
    for costly expressions that doubles the work. It is not pushed through a generator.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def assert_max_rows(df: DataFrame, limit: int, what: str = "result") -> DataFrame:
    """Fail, rather than truncate, when ``df`` has more than ``limit`` rows."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"{what} exceeds the safety limit of {limit} rows")
    return df
