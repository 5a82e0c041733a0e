"""Sums of vectors by worker, made by NumPy from Arrow batches: for models too wide for a column for each weight."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workers import WORKER

#: Rows of a batch that are turned into a matrix at once.
ROWS = 8192
Measure = Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]]


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != width * len(column):
        raise ValueError(f"rows need {width} features")
    return flat.reshape(-1, width)


def vector_partials(df: DataFrame, measure: Measure, width: int, features: str = "features", label: str = "label", outputs: int | None = None) -> DataFrame:
    """(worker_id, n, error, vector): sums over each worker's rows of measure(features, labels) = (error, vector). With `outputs` the label is an array of as many.

    A task folds its batches and sends a row for each worker that it met; those are added up element by element.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                owner = b.column(0).to_numpy(zero_copy_only=False)
                x, y = matrix(b.column(1), width), b.column(2).to_numpy(zero_copy_only=False) if outputs is None else matrix(b.column(2), outputs)
                for w in np.unique(owner):
                    own = owner == w
                    error, vector = measure(x[own], y[own])
                    sums = held.setdefault(int(w), [0, 0.0, np.zeros(len(vector))])
                    sums[0] += int(own.sum())
                    sums[1] += float(error)
                    sums[2] += vector
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([*held], pa.int32()), pa.array([s[0] for s in held.values()], pa.int64()), pa.array([s[1] for s in held.values()], pa.float64()), pa.array([s[2] for s in held.values()], pa.list_(pa.float64()))], ["worker_id", "n", "error", "vector"])

    parts = df.select(F.col(WORKER).cast("int"), F.col(features).cast("array<double>"), F.col(label).cast("double" if outputs is None else "array<double>")).mapInArrow(fold, f"{WORKER} int, n bigint, error double, vector array<double>")
    long = parts.select(WORKER, "n", "error", F.posexplode("vector").alias("pos", "v"))
    sums = long.groupBy(WORKER, "pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("error").alias("error"))
    whole = sums.groupBy(WORKER).agg(F.first("n").alias("n"), F.first("error").alias("error"), F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("all"))
    return whole.select(WORKER, "n", "error", F.transform("all", lambda x: x["v"]).alias("vector"))
