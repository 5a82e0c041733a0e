"""States of past iterations in a shared folder, from which a job goes on after a failure."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Checkpoints:
    """One folder for each iteration, of which the last `retain` stay. A folder counts once its write is complete. `folder` is a path that driver and executors share."""

    folder: str
    retain: int = 2

    def _files(self, spark: SparkSession) -> tuple[Any, Any]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def iterations(self, spark: SparkSession) -> list[int]:
        files, path = self._files(spark)
        if not files.exists(path(self.folder)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path(self.folder))]
        found = [int(m[1]) for n in names if (m := re.fullmatch(r"state-(\d+)", n))]
        return sorted(t for t in found if files.exists(path(f"{self.folder}/state-{t}/_SUCCESS")))

    def write(self, spark: SparkSession, iteration: int, state: dict[str, Any], schema: str) -> None:
        spark.createDataFrame([state], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state-{iteration}")
        files, path = self._files(spark)
        for t in self.iterations(spark)[: -self.retain]:
            files.delete(path(f"{self.folder}/state-{t}"), True)

    def last(self, spark: SparkSession, schema: str) -> tuple[int, dict[str, Any]] | None:
        there = self.iterations(spark)
        if not there:
            return None
        row = spark.read.schema(schema).parquet(f"{self.folder}/state-{there[-1]}").first()
        return there[-1], row.asDict(recursive=True)
