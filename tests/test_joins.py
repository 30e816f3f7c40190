from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from mailsift.joins import spread_join
from mailsift.ranking import hot_keys


@pytest.fixture
def large(spark):
    """A third of all rows has one key."""
    return spark.range(3000).select(
        F.col("id").alias("ingest_seq"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("kept", [["hot", "k1", "k2", "new"], ["k1"]])
def test_salting_changes_no_result(spark, large, how, kept):
    keyed = spark.createDataFrame([(k, i) for i, k in enumerate(kept)], "key string, info long")
    plain = large.join(keyed, "key", how)
    assert rows(spread_join(large, keyed, "key", how, hot=hot_keys(large, "key", 500), spread=8), *plain.columns) == rows(plain)
    assert rows(spread_join(large, keyed, "key", how), *plain.columns) == rows(plain)


def test_hot_key_is_shared_by_many_tasks(spark, large):
    keyed = spark.createDataFrame([("hot",)], "key string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = spread_join(large, keyed, "key", "left_semi", hot=hot_keys(large, "key", 500), spread=16)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 1000 and max(sizes) < 800
