"""Helpers shared by the operators of this package."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.session import scratch_path

# Fixed value: a word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage is cut, so a lost executor never changes what was decided, and the
    table is computed once however often it is used.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Bits of a filter of keys. The filter only spares work: keys that it lets through by
# chance are joined away, so a filter that has filled up makes nothing wrong.
FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame, hashed: Column, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each key's 64-bit hash; the size is fixed, whatever the number of keys."""
    words = (
        keys.select(F.pmod(hashed, F.lit(bits)).alias("bit"))
        .groupBy(F.expr("bit div 64").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
        .toArrow()
    )
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table


def may_hold(table: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which of the hashes a filter lets through."""
    bit = np.mod(hashed, np.int64(len(table) * 64))
    return (table[bit >> 6] >> (bit & 63)) & 1 == 1


def let_through(df: DataFrame, column: str, table: np.ndarray) -> DataFrame:
    """The rows of ``df`` whose bigint ``column`` is not null and passes a filter of its values.

    Used before a shuffle of wide rows; the exact join still follows.
    """
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            keys = batch.column(column)
            good = may_hold(shared.value, keys.fill_null(0).to_numpy())
            yield batch.filter(pc.and_(pa.array(good), keys.is_valid()))

    return df.mapInArrow(run, df.schema)
