"""Iterations that go on without late workers, and workers that are slow again and again.

A Spark stage is a barrier, so each worker's part of the plan runs as a job of its own, several at once; what has come in when the time and the share of workers are
reached is the iteration's result, and the jobs of the others are cancelled.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession

#: With up to so many workers all are waited for.
ALL = 10


class StragglerError(RuntimeError):
    """A worker took too long too often, and it can't be left out."""


@dataclass
class Partial:
    """How a job's iterations end.

    workers: their ids. ratio: the share of them that must be there; all of up to `ALL`. timeout: seconds before which the iteration waits for all; in the first and the last
    iteration `edge_timeout`. at_once: Spark jobs side by side.

    slow, times: a worker that was late, or whose part took `slow` seconds or more, in `times` iterations (in all, not in a row) isn't asked again; if then fewer
    than the share are left, the job fails with a StragglerError. slow None: no such watch.
    """

    workers: Sequence[int]
    ratio: float = 1.0
    timeout: float = 5.0
    edge_timeout: float = 60.0
    at_once: int = 8
    slow: float | None = None
    times: int = 3
    seconds: dict[int, float] = field(default_factory=dict)
    strikes: dict[int, int] = field(default_factory=dict)
    stopped: set[int] = field(default_factory=set)
    late: list[tuple[int, int]] = field(default_factory=list)

    @property
    def least(self) -> int:
        n = len(self.workers)
        return n if n <= ALL else int(n * self.ratio)

    def collect(self, session: SparkSession, plan_of: Callable[[int], DataFrame | None], iteration: int, total: int) -> list[Row]:
        """Rows of the workers that came in time, by worker, of which each has a plan. `late` remembers (iteration, worker) of the others."""
        asked = [w for w in self.workers if w not in self.stopped]
        if len(asked) < self.least:
            raise StragglerError(f"workers {sorted(self.stopped)} are too slow, and {self.least} of {len(self.workers)} must go on")
        timeout = self.edge_timeout if iteration in (1, total) else self.timeout
        spark, name, began = session.sparkContext, uuid.uuid4().hex, time.monotonic()

        def ask(worker: int) -> tuple[list[Row], float]:
            spark.setJobGroup(f"{name}-{worker}", f"iteration {iteration}, worker {worker}", interruptOnCancel=True)
            at, plan = time.monotonic(), plan_of(worker)
            return plan.collect() if plan is not None else [], time.monotonic() - at

        pool = ThreadPoolExecutor(max_workers=max(1, min(self.at_once, len(asked))))
        jobs = {pool.submit(inheritable_thread_target(session)(ask), w): w for w in asked}
        waiting = set(jobs)
        try:
            while waiting:
                left = began + timeout - time.monotonic()
                done = len(jobs) - len(waiting)
                if left <= 0 and done >= self.least:
                    break
                finished, waiting = wait(waiting, timeout=left if left > 0 else None, return_when=FIRST_COMPLETED)
                for f in finished:
                    f.result()
        finally:
            for f in waiting:
                f.cancel()
                spark.cancelJobGroup(f"{name}-{jobs[f]}")
            pool.shutdown(wait=False, cancel_futures=True)
        out = {w: f.result() for f, w in jobs.items() if f not in waiting}
        for w in asked:
            self.seconds[w] = out[w][1] if w in out else time.monotonic() - began
            if self.slow is not None and (w not in out or self.seconds[w] >= self.slow):
                self.strikes[w] = self.strikes.get(w, 0) + 1
                if self.strikes[w] >= self.times:
                    self.stopped.add(w)
        self.late += [(iteration, w) for w in asked if w not in out]
        return [r for w in sorted(out) for r in out[w][0]]
