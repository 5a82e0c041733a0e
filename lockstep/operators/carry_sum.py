"""Carry-sum: each worker adds the last total to the sum of its values; the new total is the sum over workers.

So the result depends on the number of workers W: M_t = W * M_{t-1} + S.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.job import Context, IterativeJob, State
from ..sources.workers import WORKER

SCHEMA = "halt boolean, value bigint"


def worker_sums(df: DataFrame) -> DataFrame:
    """(worker_id, s): what doesn't change between iterations, so the source is read once however many there are."""
    return df.groupBy(WORKER).agg(F.sum("value").alias("s"))


def worker_totals(sums: DataFrame, state: State | None, context: Context | None = None) -> DataFrame:
    """(worker_id, value): R_t of each worker."""
    return sums.select(WORKER, (F.col("s") + F.lit(state["value"] if state else 0)).alias("value"))


def carry_sum_job(df: DataFrame, max_iter: int = 50, halt_above: int | None = 1_000_000, **more: object) -> IterativeJob:
    """Over (worker_id, value long). Halts when the total exceeds `halt_above`. Null values count as nothing; a worker whose values are all null has no result."""

    def master(rows: list, state: State | None, context: Context) -> State:
        value = sum(r["value"] for r in rows if r["value"] is not None)
        return {"halt": halt_above is not None and value > halt_above, "value": value}

    return IterativeJob(df, worker_totals, master, SCHEMA, max_iter=max_iter, prepare=worker_sums, combine=lambda r: r.agg(F.sum("value").alias("value")), **more)


def line_worker(data: DataFrame, state: State | None, context: Context) -> DataFrame:
    """As `worker_totals`, over lines (worker_id, value) that each hold a whole number; others raise."""
    return worker_totals(worker_sums(data.select(WORKER, F.col("value").cast("long").alias("value"))), state)


def line_master(rows: list, state: State | None, context: Context) -> State:
    """The sum over workers; halts above the option `halt.above`, if there is one."""
    value, limit = sum(r["value"] for r in rows), context.options.get("halt.above")
    return {"halt": limit is not None and value > int(limit), "value": value}
