"""The iterative job: a worker plan for each iteration, a global update, and the loop around them.

    M_0 = None
    for t in 1..T:   R_t = worker(data, M_{t-1}, context)      a DataFrame, one row for each logical worker
                     M_t = master(rows of R_t, M_{t-1}, context)
                     stop if M_t["halt"]

The state M is a dict that `schema` describes; it goes back into the next plan as literals, so plans don't grow with the
iterations. Data are prepared and, on request, persisted once. What reaches the driver each time is one row for each worker, or what `combine`
makes of them on the executors.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.workers import WORKER
from .checkpoint import Checkpoints
from .hooks import Hook
from .partial import Partial

State = dict[str, Any]
Worker = Callable[[DataFrame, State | None, "Context"], DataFrame | None]
Master = Callable[[list[Row], State | None, "Context"], State]


@dataclass
class Context:
    """What hooks, workers and masters see of the job."""

    spark: SparkSession
    name: str
    total: int
    options: dict[str, Any]
    iteration: int = 0
    state: State | None = None
    results: list[Row] = field(default_factory=list)
    callbacks: list[Callable[[Context], None]] = field(default_factory=list)
    group: str = ""

    def on_completion(self, callback: Callable[[Context], None]) -> None:
        """Runs after the loop, before the hooks' after_application, also if the loop failed."""
        self.callbacks.append(callback)


@dataclass(frozen=True)
class Result:
    """The last state, all states by iteration, and whether a halt ended the loop."""

    spark: SparkSession
    schema: str
    iteration: int
    states: dict[int, State]
    halted: bool
    data: DataFrame

    @property
    def state(self) -> State:
        return self.states[self.iteration]

    def frame(self) -> DataFrame:
        """The last state as a DataFrame of one row."""
        return self.spark.createDataFrame([self.state], self.schema)

    def trace(self) -> DataFrame:
        """Every state of this run with its iteration."""
        return self.spark.createDataFrame([{"iteration": t} | s for t, s in sorted(self.states.items())], f"iteration int, {self.schema}")


@dataclass(frozen=True)
class IterativeJob:
    """See the module. Optional parts:

    prepare: loop-invariant work, done once on the data (projection, sufficient statistics by worker).
    storage: level at which the prepared data are kept; None rereads the source each time.
    combine: reduces R_t on the executors.
    setup, cleanup: run at the first iteration of a run and after the loop.
    halt_on_all_workers: the rows of R_t have a column halt; if it is true in all (at least one), M_t halts.
    partial: lets iterations go on without late workers; `combine` then doesn't apply, as each worker's rows come on their own (the worker function gets one worker's data at a time).
    timeout: seconds for one iteration's plan; beyond it the Spark jobs are cancelled. With `soft` the master then gets no rows, else (and always at the first
    iteration) the job fails.
    """

    data: DataFrame
    worker: Worker
    master: Master
    schema: str
    max_iter: int = 50
    name: str = "iterative"
    prepare: Callable[[DataFrame], DataFrame] | None = None
    storage: StorageLevel | None = field(default_factory=lambda: StorageLevel.MEMORY_AND_DISK)
    combine: Callable[[DataFrame], DataFrame] | None = None
    setup: Callable[[Context], None] | None = None
    cleanup: Callable[[Context], None] | None = None
    hooks: tuple[Hook, ...] = ()
    system_hooks: tuple[Hook, ...] = ()
    checkpoints: Checkpoints | None = None
    halt_on_all_workers: bool = False
    partial: Partial | None = None
    timeout: float | None = None
    soft: bool = True
    progress: Callable[[int, int, str], None] | None = None
    options: dict[str, Any] = field(default_factory=dict)

    def run(self, resume: bool = False, on_result: Callable[[Result], None] | None = None) -> Result:
        """Runs the loop; with `resume` from the last state that the checkpoints hold. `on_result` gets the result as soon as it stands, before what is called after the loop."""
        if self.max_iter < 1:
            raise ValueError("max_iter must be at least 1")
        if self.partial and (self.combine or self.timeout is not None):
            raise ValueError("partial goes with neither combine nor timeout")
        spark = self.data.sparkSession
        context = Context(spark, self.name, self.max_iter, self.options)
        hooks = [*self.system_hooks, *self.hooks]
        if self.cleanup:
            context.on_completion(self.cleanup)
        states: dict[int, State] = {}
        if resume and self.checkpoints and (last := self.checkpoints.last(spark, self.schema)):
            context.iteration, context.state = last
            states[last[0]] = last[1]
        for hook in hooks:
            hook.before_application(context)
        data = self.prepare(self.data) if self.prepare else self.data
        kept = data.persist(self.storage) if self.storage else data
        error: BaseException | None = None
        try:
            if self.setup:
                self.setup(context)
            while context.iteration < self.max_iter and not (context.state or {}).get("halt"):
                context.iteration += 1
                self._iterate(kept, context, hooks)
                states[context.iteration] = context.state
            if on_result:
                on_result(self._result(context, states, data))
        except BaseException as e:  # noqa: BLE001  raised again below, after the clean-up
            error = e
        error = self._after(context.callbacks, context, error)
        error = self._after([h.after_application for h in reversed(hooks)], context, error)
        if self.storage:
            kept.unpersist()
        if error:
            raise error
        return self._result(context, states, data)

    def _result(self, context: Context, states: dict[int, State], data: DataFrame) -> Result:
        return Result(context.spark, self.schema, context.iteration, states, bool((context.state or {}).get("halt")), data)

    def _iterate(self, data: DataFrame, context: Context, hooks: list[Hook]) -> None:
        for hook in hooks:
            hook.before_iteration(context)
        spark, group = context.spark.sparkContext, f"{self.name}-{uuid.uuid4().hex}"
        context.group = group
        if self.partial:
            of = lambda w: self.worker(data.where(F.col(WORKER) == w), context.state, context)
            context.results = self.partial.collect(context.spark, of, context.iteration, self.max_iter)
        else:
            plan = self.worker(data, context.state, context)
            if plan is not None and self.combine:
                plan = self.combine(plan)
            context.results = self._collect(plan, spark, group, context) if plan is not None else []
        state = self.master(context.results, context.state, context)
        if self.halt_on_all_workers and context.results and all(r["halt"] for r in context.results):
            state = state | {"halt": True}
        context.state = state
        if self.checkpoints:
            self.checkpoints.write(context.spark, context.iteration, state, self.schema)
        for hook in reversed(hooks):
            hook.after_iteration(context)
        if self.progress:
            self.progress(context.iteration, self.max_iter, "halted" if state.get("halt") else "running")

    def _collect(self, plan: DataFrame, spark: Any, group: str, context: Context) -> list[Row]:
        about = f"{self.name}: iteration {context.iteration} of {self.max_iter}"
        before = spark.getLocalProperty("spark.jobGroup.id")
        spark.setJobGroup(group, about, interruptOnCancel=True)
        if self.timeout is None:
            try:
                return plan.collect()
            finally:
                spark.setLocalProperty("spark.jobGroup.id", before)
                spark.setJobDescription(None)
        late = threading.Event()
        timer = threading.Timer(self.timeout, lambda: (late.set(), spark.cancelJobGroup(group)))
        timer.start()
        try:
            return plan.collect()
        except Exception as e:
            if not late.is_set():
                raise
            if self.soft and context.iteration > 1:
                return []
            raise TimeoutError(f"{about} took more than {self.timeout} s") from e
        finally:
            timer.cancel()
            spark.setLocalProperty("spark.jobGroup.id", before)
            spark.setJobDescription(None)

    @staticmethod
    def _after(calls: list[Callable[[Context], None]], context: Context, error: BaseException | None) -> BaseException | None:
        """All are called; the first error counts."""
        for call in calls:
            try:
                call(context)
            except Exception as e:  # noqa: BLE001  the first one is raised by run
                error = error or e
        return error
