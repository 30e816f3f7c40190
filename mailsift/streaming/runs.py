"""A table that micro-batches add to, each exactly once however often it is run.

A batch writes one run, the folder ``run=FIRST_LAST`` with its own number twice, and a batch
that is run again overwrites that folder. After every ``FAN`` batches their runs are merged
into one that covers them, after every ``FAN`` of those once more, and so on: a table of n
batches is read from about ``FAN`` runs for each power of ``FAN`` in n. A run counts once it has
been written to its end, and a run that a longer one covers is no longer read. Covered runs are
deleted by a later batch only, so that a batch which is run again finds what it found before.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FAN = 16
_RUN = re.compile(r"run=(\d+)_(\d+)$")

Run = tuple[int, int]


class RunTable:
    """Rows of ``schema`` under ``path``, in folders by the columns of ``parts`` within each run."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, parts: list[str], fan: int = FAN):
        self.spark, self.path, self.parts, self.fan = spark, path.rstrip("/"), parts, fan
        self.schema = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
        jvm = spark.sparkContext._jvm
        self._folder = jvm.org.apache.hadoop.fs.Path
        self._fs = self._folder(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, run: Run) -> str:
        return f"{self.path}/run={run[0]}_{run[1]}"

    def runs(self) -> list[Run]:
        """Runs that were written to their end."""
        found = []
        for status in self._fs.globStatus(self._folder(f"{self.path}/run=*/_SUCCESS")) or []:
            match = _RUN.search(str(status.getPath().getParent().getName()))
            if match:
                found.append((int(match[1]), int(match[2])))
        return sorted(found)

    @staticmethod
    def uncovered(runs: list[Run]) -> list[Run]:
        """The longest runs; those of aligned powers either contain each other or are apart."""
        kept: list[Run] = []
        for run in sorted(runs, key=lambda r: (r[0], -r[1])):
            if not kept or run[0] > kept[-1][1]:
                kept.append(run)
        return kept

    def read(self, before: int) -> DataFrame:
        """Rows of the batches below ``before``, with their run."""
        paths = [self._at(r) for r in self.uncovered([r for r in self.runs() if r[1] < before])]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*paths)

    def put(self, batch_id: int, rows: DataFrame) -> None:
        """Make ``rows`` the run of a batch, whatever an earlier try has left."""
        self._write((batch_id, batch_id), rows)

    def _write(self, run: Run, rows: DataFrame) -> None:
        rows.write.mode("overwrite").partitionBy(*self.parts).parquet(self._at(run))

    def merge(self, batch_id: int, combine: Callable[[DataFrame], DataFrame]) -> None:
        """Merge the runs that end with this batch, level by level."""
        width = self.fan
        while (batch_id + 1) % width == 0:
            first = batch_id + 1 - width
            inside = [r for r in self.runs() if first <= r[0] and r[1] <= batch_id and r != (first, batch_id)]
            parts = [self._at(r) for r in self.uncovered(inside)]
            if parts:
                rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*parts).drop("run")
                self._write((first, batch_id), combine(rows))
            width *= self.fan

    def vacuum(self, before: int) -> None:
        """Delete runs below ``before`` that a longer one below it covers."""
        done = [r for r in self.runs() if r[1] < before]
        for run in set(done) - set(self.uncovered(done)):
            self._fs.delete(self._folder(self._at(run)), True)
