"""Calls of thread models: order, bounds, calls at the same time."""

from __future__ import annotations

import os
import sys
import threading
from collections import Counter

import pytest
from pyspark import cloudpickle

from mailsift.operators import infer
from mailsift.operators.infer import score_threads, score_threads_once

# Workers cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENTRIES = "thread_id string, position long, content string"


def answer(thread):
    return thread.assign(category=thread["content"], confidence=0.5, actionable=False, summary="")


@pytest.fixture
def entries(spark):
    data = [(f"t{i}", p, f"{i}.{p}" if p else None) for i in range(12) for p in (2, 0, 1)]
    return spark.createDataFrame([*data, (None, 0, "no id")], ENTRIES)


@pytest.mark.parametrize("calls", [1, 3])
def test_pieces_come_in_order_whatever_the_calls(entries, calls):
    got = {r["thread_id"]: r for r in score_threads(entries, lambda thread, _: answer(thread), calls=calls).collect()}
    assert {t: r["category"] for t, r in got.items() if t} == {f"t{i}": f"{i}.1\n\n{i}.2" for i in range(12)}
    assert all(r["error"] is None for t, r in got.items() if t) and len(got) == 13


def test_a_task_makes_its_calls_at_the_same_time(spark, entries):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = score_threads(entries.filter("thread_id is not null"), Meeting(3), calls=3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(rows) == 12 and all(r["error"] is None for r in rows)


class Meeting:
    """A model whose calls wait for each other; its barrier is made in the worker."""

    def __init__(self, size):
        self.size = size

    def __setstate__(self, state):
        self.barrier = threading.Barrier(state["size"])

    def __call__(self, thread, _):
        self.barrier.wait(timeout=30)
        return answer(thread)


def test_a_thread_that_is_too_long_fails_alone(spark):
    data = [("a", 0, "x" * 6), ("a", 1, "y" * 6), ("b", 0, "z" * 10), ("c", 0, "w" * 11)]
    df = spark.createDataFrame(data, ENTRIES)
    got = {r["thread_id"]: r for r in score_threads(df, lambda thread, _: answer(thread), max_chars=10).collect()}
    assert got["b"]["category"] == "z" * 10
    assert all("more than 10" in got[t]["error"] and got[t]["category"] is None for t in "ac")


def test_calls_must_be_positive(entries):
    with pytest.raises(ValueError, match="calls"):
        score_threads(entries, answer, calls=0)


class Logged:
    """A model that notes what it is asked; it breaks its worker once, at a thread that is named."""

    def __init__(self, folder, breaks_at=None):
        self.log, self.broken, self.breaks_at = f"{folder}/asked", f"{folder}/broken", breaks_at

    def __call__(self, thread, _):
        name = thread["thread_id"].iloc[0]
        if name == self.breaks_at and not os.path.exists(self.broken):
            open(self.broken, "w").close()
            os._exit(1)
        with open(self.log, "a") as log:
            log.write(f"{name}\n")
        return answer(thread)

    def asked(self):
        with open(self.log) as log:
            return Counter(log.read().split("\n")[:-1])


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("calls", [1, 3])
def test_kept_answers_equal_those_of_plain_calls(entries, tmp_path, calls):
    once = score_threads_once(entries, lambda thread, _: answer(thread), f"{tmp_path}/kept", calls=calls, keep_every=4)
    assert plain(once) == plain(score_threads(entries, lambda thread, _: answer(thread)))


def test_a_task_that_breaks_asks_no_thread_twice(spark, entries, tmp_path):
    model, some = Logged(tmp_path, "t7"), entries.filter("thread_id is not null")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        with pytest.raises(Exception):
            score_threads_once(some, model, f"{tmp_path}/kept", keep_every=1).collect()
        assert 0 < sum(model.asked().values()) < 12
        got = score_threads_once(some, model, f"{tmp_path}/kept", keep_every=1)
        assert plain(got) == plain(score_threads(some, lambda thread, _: answer(thread)))
        assert set(model.asked().values()) == {1} and len(model.asked()) == 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_changed_threads_and_errors_are_asked_about_again(spark, tmp_path):
    first = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y"), ("c", 0, "too long")], ENTRIES)
    then = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y"), ("b", 1, "z"), ("c", 0, "too long")], ENTRIES)
    model, kept = Logged(tmp_path), f"{tmp_path}/kept"
    rows = {r["thread_id"]: r for r in score_threads_once(first, model, kept, max_chars=5).collect()}
    assert rows["c"]["error"] and rows["a"]["category"] == "x"
    rows = {r["thread_id"]: r["category"] for r in score_threads_once(then, model, kept).collect()}
    assert rows == {"a": "x", "b": "y\n\nz", "c": "too long"}
    assert model.asked() == {"a": 1, "b": 2, "c": 1}


def test_a_second_try_finds_what_the_first_has_kept(tmp_path):
    import pandas as pd

    row = pd.DataFrame([["a", "x", 0.5, True, "", None, "k", "r"]], columns=infer.KEPT_COLUMNS)
    failed = pd.DataFrame([[None, None, None, None, None, "E: no", "l", "r"]], columns=infer.KEPT_COLUMNS)
    infer._keep(str(tmp_path), "r-000001", [row, failed])
    infer._keep(f"file:{tmp_path}", "r-000002", [row.assign(thread_id="b")])
    found = infer._kept_by(str(tmp_path), "r-000001")
    assert set(found) == {("a", "k"), (None, "l")}
    assert found["a", "k"].iloc[0].to_list() == ["a", "x", 0.5, True, "", None]
