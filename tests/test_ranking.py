from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from mailsift import ranking
from mailsift.operators.packing import pack_or_queries
from mailsift.session import scratch_root


@pytest.fixture
def skewed(spark):
    """One group holds most rows."""
    df = spark.range(5000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.col("id").alias("seq"),
        (F.col("id") * 7919 % 101).alias("score"),
    )
    return df.repartition(5)


def brute(data, order):
    out, seen = {}, {}
    for r in sorted(data, key=order):
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        out[r["seq"]] = seen[r["g"]]
    return out


def test_number_by_sequence(skewed):
    got = {r["seq"]: r["rn"] for r in ranking.number_by_sequence(skewed, ["g"], "seq", "rn").collect()}
    assert got == brute(skewed.collect(), lambda r: r["seq"])


def test_numbers_of_a_whole_table_need_no_single_task(skewed):
    numbered = ranking.number_by_sequence(skewed, [], "seq", "rn")
    assert "SinglePartition" not in numbered._jdf.queryExecution().executedPlan().toString()
    got = [r["rn"] for r in numbered.orderBy("seq").collect()]
    assert got == list(range(1, len(got) + 1))


def test_number_by_order_ignores_partitioning(skewed):
    order = [F.desc("score"), F.col("seq")]
    want = brute(skewed.collect(), lambda r: (-r["score"], r["seq"]))
    for df in (skewed, skewed.coalesce(1)):
        got = {r["seq"]: r["rn"] for r in ranking.number_by_order(df, ["g"], order, "rn").collect()}
        assert got == want


def test_chunks_are_full_but_the_last(skewed):
    sizes = ranking.chunk(skewed, ["g"], "seq", 300).groupBy("g", "chunk_no").count()
    hot = [r["count"] for r in sizes.filter("g = 'hot'").orderBy("chunk_no").collect()]
    assert hot[:-1] == [300] * (len(hot) - 1) and sum(hot) == 4000


def test_last_first_latest_wins(spark):
    df = spark.createDataFrame(
        [("a", 1, 10), ("a", 2, 10), ("a", 3, 5), ("b", 4, None)], "k string, seq long, moment long"
    )
    assert rows(ranking.last_wins(df, ["k"], "seq"), "k", "seq") == [("a", 3), ("b", 4)]
    assert rows(ranking.first_wins(df, ["k"], "seq"), "k", "seq") == [("a", 1), ("b", 4)]
    # Of equal moments the first row stays.
    assert ("a", 1) in rows(ranking.latest_wins(df, ["k"], "moment", "seq"), "k", "seq")


def test_assert_max_rows(spark):
    assert ranking.assert_max_rows(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        ranking.assert_max_rows(spark.range(6), 5)


def test_computed_once_is_a_border_for_filters(spark):
    df = ranking.computed_once(spark.range(3).select((F.col("id") * 2).alias("x"))).filter("x > 2")
    assert [r["x"] for r in df.collect()] == [4]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")


def test_scratch_follows_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


def greedy(senders, max_chars, max_items, overhead):
    """The packing rule, one sender after the other."""
    batches, current, length = [], [], overhead
    for s in senders:
        clause = len("from:") + len(s)
        grown = length + (4 if current else 0) + clause
        if current and (grown > max_chars or (max_items is not None and len(current) >= max_items)):
            batches.append(current)
            current, length = [], overhead
            grown = overhead + clause
        current.append(s)
        length = grown
    return batches + ([current] if current else [])


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("max_chars", "max_items", "wrap"), [(60, None, ("", "")), (200, 3, ("in:inbox (", ")")), (30, 5, ("", ""))])
def test_packing_matches_greedy(spark, seed, max_chars, max_items, wrap):
    """Tiny blocks, so that queries cross many block borders."""
    rng = random.Random(seed)
    groups = {g: sorted({"x" * rng.randint(1, 40) + str(rng.randint(0, 999)) for _ in range(n)}) for g, n in (("a", 300), ("b", 1), ("c", 47))}
    data = [(g, s) for g, senders in groups.items() for s in senders]
    schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("sender", T.StringType())])
    df = spark.createDataFrame(data, schema)
    packed = pack_or_queries(df, ["g"], max_chars=max_chars, max_items=max_items, wrap=wrap, block=8, fan=2)
    got = {g: [] for g in groups}
    for r in packed.orderBy("g", "batch_no").collect():
        assert r["batch_no"] == len(got[r["g"]])
        assert r["query"] == wrap[0] + " OR ".join("from:" + s for s in r["senders"]) + wrap[1]
        got[r["g"]].append(list(r["senders"]))
    overhead = len(wrap[0]) + len(wrap[1])
    assert got == {g: greedy(s, max_chars, max_items, overhead) for g, s in groups.items()}


def test_packing_rejects_bad_caps(spark):
    df = spark.createDataFrame([("a@x.org",)], "sender string")
    for caps in ({"max_chars": 0}, {"max_items": 0}):
        with pytest.raises(ValueError):
            pack_or_queries(df, **caps)


def test_running_total(spark):
    df = spark.createDataFrame([(f"f{i % 5}", i, i % 4) for i in range(100)], "file string, block long, n long").repartition(7)
    got = sorted(tuple(r) for r in ranking.running_total(df, ["file", "block"], "n", "before").select("file", "block", "n", "before").collect())
    assert len(got) == 100
    total = 0
    for _, _, n, before in got:
        assert before == total
        total += n
    assert ranking.running_total(df.limit(0), ["file", "block"], "n", "before").collect() == []
