"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextvars
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that hold at any scale: adaptive re-planning chooses join strategy,
# splits skewed partitions and merges small ones from measured sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # Folders of many small files are listed by a few hundred tasks, not by one task for each path.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
}


def configure(builder):
    """Apply the engine's settings to a ``SparkSession.builder``."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def apply_settings(spark: SparkSession) -> SparkSession:
    """Apply the engine's settings to a session that something else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only a local master may go without the setting; there a temporary folder is
    made once per session. A cluster without it is an error, because a folder of
    one machine would not survive the loss of that machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="spark-mailsift-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


# The run whose folder staged tables go to; None stands for the application's own.
_run: contextvars.ContextVar[str | None] = contextvars.ContextVar("mailsift_run", default=None)


def _run_folder(spark: SparkSession, run: str | None) -> str:
    return f"{scratch_root(spark)}/mailsift/{run or spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder of the current run."""
    return f"{_run_folder(spark, _run.get())}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """A run with a folder of its own, deleted at the end; what it staged must be used up by then.

    Runs at the same time, also of other applications on the same root, do not see each other.
    """
    name = f"run-{uuid.uuid4().hex}"
    token = _run.set(name)
    try:
        yield _run_folder(spark, name)
    finally:
        _run.reset(token)
        _delete(spark, _run_folder(spark, name))


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that a lost executor cannot make a range-partitioned
    stage come out differently, and gives later joins true sizes to plan with.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_scratch(spark: SparkSession) -> None:
    """Delete what this application staged outside of runs; call once its jobs are over."""
    _delete(spark, _run_folder(spark, None))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
