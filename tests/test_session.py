from __future__ import annotations

import threading

import pytest

from mailsift.session import durable, release_scratch, scratch_path, scratch_run


def exists(spark, path):
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file)


def test_runs_do_not_see_each_other(spark):
    """Two runs at once; the end of one leaves the other's tables."""
    started, ended, counts = threading.Event(), threading.Event(), []

    def other():
        with scratch_run(spark):
            table = durable(spark.range(5), "other")
            started.set()
            ended.wait(60)
            counts.append(table.count())

    thread = threading.Thread(target=other)
    thread.start()
    started.wait(60)
    outside = durable(spark.range(7), "outside")
    with scratch_run(spark) as folder:
        assert durable(spark.range(3), "own").count() == 3
        assert scratch_path(spark, "x").startswith(folder) and exists(spark, folder)
    assert not exists(spark, folder) and outside.count() == 7
    ended.set()
    thread.join()
    assert counts == [5]


def test_a_failing_run_is_cleared_too(spark):
    with pytest.raises(ValueError), scratch_run(spark) as folder:
        durable(spark.range(3), "own")
        raise ValueError
    assert not exists(spark, folder)


def test_release_takes_what_the_application_staged(spark):
    with scratch_run(spark) as folder:
        inside = durable(spark.range(2), "inside")
        path = scratch_path(spark, "x")
        release_scratch(spark)
        assert inside.count() == 2 and path.startswith(folder)
