"""Linear and logistic regression by summed gradients.

The first iteration sets the weights; each later one takes a step w - rate * sum((prediction - y) * x), so T iterations take T - 1 steps. The error is the mean over
workers of each worker's mean of half squared errors, not a mean over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid
from ..functions.vectors import dot_with
from ..plans.job import Context, IterativeJob, State
from ..sources.workers import WORKER
from .optim import update
from .partials import vector_partials

SCHEMA = "halt boolean, parameters array<double>, error double"
#: Up to so many features each weight has a column of its own; beyond, NumPy adds up vectors.
WIDE = 64


def start(n: int, initial: Sequence[float] | None, seed: int | None) -> list[float]:
    """The given weights, or draws from [0, 1)."""
    if initial is not None:
        if len(initial) != n + 1:
            raise ValueError(f"{n} features need {n + 1} weights")
        return [float(w) for w in initial]
    return np.random.default_rng(seed).random(n + 1).tolist()


def columns(n: int) -> list[Column]:
    """Bias and features."""
    return [F.lit(1.0), *(F.get("features", F.lit(i)) for i in range(n))]


def predictions(df: DataFrame, weights: Sequence[float], link: str, name: str = "prediction") -> DataFrame:
    """df with the model's prediction."""
    z = dot_with(columns(len(weights) - 1), weights)
    return df.withColumn(name, sigmoid(z) if link == "logistic" else z)


def worker_gradients(df: DataFrame, weights: Sequence[float], link: str) -> DataFrame:
    """(worker_id, error, g0, g1, ...): each worker's mean half squared error and summed gradient, in one aggregation."""
    n = len(weights) - 1
    rows = predictions(df, weights, link, "__p").select(WORKER, (F.col("__p") - F.col("label")).alias("__e"), "features")
    sums = [F.sum(F.col("__e") * c).alias(f"g{i}") for i, c in enumerate(columns(n))]
    return rows.groupBy(WORKER).agg(F.avg(F.col("__e") * F.col("__e") / 2).alias("error"), *sums)


def _wide_gradients(df: DataFrame, weights: Sequence[float], link: str) -> DataFrame:
    w = np.array(weights)

    def measure(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w[1:] + w[0]
        with np.errstate(over="ignore"):
            e = (1 / (1 + np.exp(-z)) if link == "logistic" else z) - y
        return float(e @ e / 2), np.append(e.sum(), e @ x)

    sums = vector_partials(df, measure, len(weights) - 1)
    return sums.select(WORKER, (F.col("error") / F.col("n")).alias("error"), *(F.get("vector", F.lit(i)).alias(f"g{i}") for i in range(len(weights))))


def _total(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("error").alias("error"), *(F.sum(c).alias(c) for c in df.columns if c.startswith("g")))


def second_moments(df: DataFrame, n: int) -> DataFrame:
    """(worker_id, n, sums of all products of bias, features and label): all that a linear model's gradients and errors need, from one pass over the data."""
    z = [*columns(n), F.col("label")]
    sums = [F.sum(z[i] * z[j]).alias(f"m{i}_{j}") for i in range(n + 2) for j in range(i, n + 2)]
    return df.groupBy(WORKER).agg(F.count("*").alias("n"), *sums)


def _moment_gradients(moments: DataFrame, weights: Sequence[float]) -> DataFrame:
    w, n = [*weights, -1.0], len(weights) - 1
    m = lambda i, j: F.col(f"m{min(i, j)}_{max(i, j)}")
    rows = [dot_with([m(i, j) for j in range(n + 2)], w) for i in range(n + 2)]
    return moments.select(WORKER, (dot_with(rows, w) / (2 * F.col("n"))).alias("error"), *(rows[i].alias(f"g{i}") for i in range(n + 1)))


def regression_job(df: DataFrame, n_features: int, *, link: str = "linear", rate: float = 0.1, max_iter: int = 50, initial: Sequence[float] | None = None, seed: int | None = None, method: str = "scan", **more: object) -> IterativeJob:
    """Over (worker_id, features array<double>, label double). link: "linear" or "logistic".

    method: "scan" reads the (kept) rows in each iteration; "moments" (linear only) sums the products of the columns once, and iterates over a row for each worker.
    Moments lose digits where the error is tiny against the labels, so they are the caller's choice; scan doesn't.
    """
    if link not in ("linear", "logistic"):
        raise ValueError(link)
    if method not in ("scan", "moments") or (method == "moments" and link != "linear"):
        raise ValueError(f"{method} doesn't go with {link}")
    first = start(n_features, initial, seed)

    def worker(data: DataFrame, state: State | None, context: Context) -> DataFrame | None:
        if state is None:
            return None
        w = state["parameters"]
        if method == "moments":
            return _moment_gradients(data, w)
        return (worker_gradients if n_features <= WIDE else _wide_gradients)(data, w, link)

    def master(rows: list, state: State | None, context: Context) -> State:
        if state is None:
            return {"halt": False, "parameters": first, "error": 0.0}
        if not rows or rows[0]["g0"] is None:
            raise ValueError("no worker has data")
        g = [rows[0][f"g{i}"] for i in range(n_features + 1)]
        w, _ = update("descent", state["parameters"], g, rate=rate)
        return {"halt": False, "parameters": w, "error": rows[0]["error"]}

    prepare = (lambda d: second_moments(d, n_features)) if method == "moments" else (lambda d: d.select(WORKER, "features", "label"))
    return IterativeJob(df, worker, master, SCHEMA, max_iter=max_iter, prepare=prepare, combine=_total, **more)
