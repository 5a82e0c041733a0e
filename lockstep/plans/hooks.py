"""Hooks of a job. Those before something run in the order of the list, those after it in reverse; system hooks come first in the list."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from .job import Context


class Hook:
    """Does nothing; subclasses override what they need."""

    def before_application(self, context: Context) -> None: ...

    def before_iteration(self, context: Context) -> None: ...

    def after_iteration(self, context: Context) -> None: ...

    def after_application(self, context: Context) -> None: ...


class LogHook(Hook):
    """Adds (label, event, iteration) to a list, which several hooks may share."""

    def __init__(self, label: str, log: list[tuple[str, str, int]]) -> None:
        self.label, self.log = label, log

    def _say(self, event: str, context: Context) -> None:
        self.log.append((self.label, event, context.iteration))

    def before_application(self, context: Context) -> None:
        self._say("before_application", context)

    def before_iteration(self, context: Context) -> None:
        self._say("before_iteration", context)

    def after_iteration(self, context: Context) -> None:
        self._say("after_iteration", context)

    def after_application(self, context: Context) -> None:
        self._say("after_application", context)


class MetricsHook(Hook):
    """For each iteration: seconds, rows from the workers, the driver JVM's memory and collection time, and of the workers' tasks their number, their rows, run time, collection time and peak memory."""

    SCHEMA = "iteration int, results long, halted boolean, seconds double, gc_ms long, used_mb double, tasks long, task_rows long, task_ms long, task_gc_ms long, task_peak_mb double"

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def before_application(self, context: Context) -> None:
        self._factory = context.spark.sparkContext._jvm.java.lang.management.ManagementFactory

    def _gc_ms(self) -> int:
        return sum(int(b.getCollectionTime()) for b in self._factory.getGarbageCollectorMXBeans())

    def before_iteration(self, context: Context) -> None:
        self._began, self._gc = time.monotonic(), self._gc_ms()

    def after_iteration(self, context: Context) -> None:
        used = self._factory.getMemoryMXBean().getHeapMemoryUsage().getUsed() / 1e6
        self.rows.append((context.iteration, len(context.results), bool(context.state.get("halt")), time.monotonic() - self._began, self._gc_ms() - self._gc, float(used), *self._tasks(context)))

    @staticmethod
    def _tasks(context: Context) -> tuple[int, int, int, int, float]:
        """Sums over the iteration's stages, as Spark's status store has them."""
        spark = context.spark.sparkContext
        store, tracker = spark._jsc.sc().statusStore(), spark.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(context.group) if (info := tracker.getJobInfo(j)) for s in info.stageIds}
        tasks = rows = run = gc = 0
        peak = 0.0
        for s in sorted(stages):
            try:
                stage = store.lastStageAttempt(s)
            except Exception:  # noqa: BLE001  the store keeps a bounded number of stages
                continue
            tasks += int(stage.numCompleteTasks())
            rows += int(stage.inputRecords()) + int(stage.shuffleReadRecords())
            run += int(stage.executorRunTime())
            gc += int(stage.jvmGcTime())
            peak = max(peak, stage.peakExecutionMemory() / 1e6)
        return tasks, rows, run, gc, peak

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.SCHEMA)


class SinkHook(Hook):
    """Writes the last state when the job is over; errors raise."""

    def __init__(self, write: Callable[[Context], None]) -> None:
        self.write = write

    def after_application(self, context: Context) -> None:
        if context.state is not None:
            self.write(context)
