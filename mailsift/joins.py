"""Joins of a large table to a table of unique keys when one key may hold much of the large one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tasks that share the rows of one hot key.
SPREAD = 64
# Hot keys that may be broadcast.
BROADCAST_KEYS = 100_000


def spread_join(
    large: DataFrame,
    keyed: DataFrame,
    key: str,
    how: str,
    by: str = "ingest_seq",
    hot: DataFrame | None = None,
    spread: int = SPREAD,
) -> DataFrame:
    """Join ``large`` to ``keyed``, which has one row per ``key``.

    By default this is a plain join: adaptive execution splits partitions that a hot key
    has made large, from measured sizes and without a job of its own. A caller that knows
    hot keys, say from ``ranking.hot_keys`` once for several joins, passes them as ``hot``;
    then the rows of these keys are salted by column ``by``, and the rows of ``keyed`` with
    a hot key are copied once per salt. Inner, left, semi and anti joins keep their meaning,
    as every row still meets its one partner.
    """
    if hot is None:
        return large.join(keyed, key, how)
    hot = hot.select(key).distinct().withColumn("_hot", F.lit(True))
    if hot.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    salt = F.pmod(F.xxhash64(by), F.lit(spread)).cast("int")
    salted = large.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0)))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    copies = keyed.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return salted.drop("_hot").join(copies, [key, "_salt"], how).drop("_salt")
