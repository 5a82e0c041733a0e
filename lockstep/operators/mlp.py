"""A neural network with one hidden layer: sigmoid units, biases on input and hidden layer, trained on summed gradients.

Weights are one list: for each hidden unit its bias and its weights by input, then for each output its bias and its weights by hidden unit. Gradients point downhill
and have 0.1 added to the sigmoid's slope, so that saturated units still learn.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid
from ..functions.vectors import dot_with
from ..plans.job import Context, IterativeJob, State
from ..sources.workers import WORKER
from .optim import update
from .partials import vector_partials

SCHEMA = "halt boolean, train_error double, test_error double, train_size bigint, weights array<double>, gradients array<double>, memory map<string,array<double>>, frozen_size bigint"
FLAT_SPOT = 0.1
#: Up to so many weights gradients are column expressions; beyond, NumPy makes them.
WIDE = 64


@dataclass(frozen=True)
class Shape:
    inputs: int
    hidden: int
    outputs: int = 1

    @property
    def size(self) -> int:
        return self.hidden * (self.inputs + 1) + self.outputs * (self.hidden + 1)

    def split(self, weights: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        if len(weights) != self.size:
            raise ValueError(f"{self} needs {self.size} weights")
        w, cut = np.array(weights, float), self.hidden * (self.inputs + 1)
        return w[:cut].reshape(self.hidden, -1), w[cut:].reshape(self.outputs, -1)


def _units(df: DataFrame, below: list[Column], weights: np.ndarray, name: str) -> DataFrame:
    return df.withColumns({f"{name}{i}": sigmoid(dot_with(below, w)) for i, w in enumerate(weights)})


def forward(df: DataFrame, weights: Sequence[float], shape: Shape) -> DataFrame:
    """df with h0, h1, ... and o0, o1, ...: hidden and output units, as column expressions."""
    first, second = shape.split(weights)
    x = [F.lit(1.0), *(F.get("features", F.lit(i)) for i in range(shape.inputs))]
    h = [F.lit(1.0), *(F.col(f"h{i}") for i in range(shape.hidden))]
    return _units(_units(df, x, first, "h"), h, second, "o")


def column_gradients(df: DataFrame, weights: Sequence[float], shape: Shape) -> DataFrame:
    """(worker_id, n, error, g0, g1, ...): each worker's rows, mean squared error and summed gradients. df has label (one output) or labels (an array)."""
    _, second = shape.split(weights)
    target = [F.get("labels", F.lit(k)) for k in range(shape.outputs)] if "labels" in df.columns else [F.col("label")]
    slope = lambda u: u * (F.lit(1.0) - u) + F.lit(FLAT_SPOT)
    out, hidden = [F.col(f"o{k}") for k in range(shape.outputs)], [F.col(f"h{j}") for j in range(shape.hidden)]
    x = forward(df, weights, shape)
    x = x.withColumns({f"e{k}": target[k] - o for k, o in enumerate(out)})
    x = x.withColumns({f"d{k}": F.col(f"e{k}") * slope(o) for k, o in enumerate(out)})
    x = x.withColumns({f"q{j}": dot_with([F.col(f"d{k}") for k in range(shape.outputs)], second[:, j + 1]) * slope(h) for j, h in enumerate(hidden)})
    inputs = [F.lit(1.0), *(F.get("features", F.lit(i)) for i in range(shape.inputs))]
    products = [F.col(f"q{j}") * v for j in range(shape.hidden) for v in inputs] + [F.col(f"d{k}") * v for k in range(shape.outputs) for v in [F.lit(1.0), *hidden]]
    error = sum((F.col(f"e{k}") * F.col(f"e{k}") for k in range(shape.outputs)), F.lit(0.0)) / shape.outputs
    return x.groupBy(WORKER).agg(F.count("*").alias("n"), F.avg(error).alias("error"), *(F.sum(p).alias(f"g{i}") for i, p in enumerate(products)))


def batch_gradient(shape: Shape, weights: Sequence[float], x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed squared error (by output) and summed gradient of a batch."""
    first, second = shape.split(weights)
    y = y.reshape(len(x), -1)
    one = np.ones((len(x), 1))
    with np.errstate(over="ignore"):
        inputs = np.hstack([one, x])
        h = 1 / (1 + np.exp(-inputs @ first.T))
        hidden = np.hstack([one, h])
        o = 1 / (1 + np.exp(-hidden @ second.T))
    e = y - o
    d = e * (o * (1 - o) + FLAT_SPOT)
    q = d @ second[:, 1:] * (h * (1 - h) + FLAT_SPOT)
    return float((e * e).sum() / shape.outputs), np.concatenate([(q.T @ inputs).ravel(), (d.T @ hidden).ravel()])


def batch_gradients(df: DataFrame, weights: Sequence[float], shape: Shape) -> DataFrame:
    """As column_gradients, by NumPy over Arrow batches. The gradient is an array g."""
    w, several = list(weights), "labels" in df.columns
    sums = vector_partials(df, lambda x, y: batch_gradient(shape, w, x, y), shape.inputs, label="labels" if several else "label", outputs=shape.outputs if several else None)
    return sums.select(WORKER, "n", (F.col("error") / F.col("n")).alias("error"), F.col("vector").alias("g"))


def mean_error(df: DataFrame, weights: Sequence[float], shape: Shape) -> DataFrame:
    """(worker_id, test_error): mean squared error of each worker's rows."""
    target = [F.get("labels", F.lit(k)) for k in range(shape.outputs)] if "labels" in df.columns else [F.col("label")]
    square = sum(((t - F.col(f"o{k}")) * (t - F.col(f"o{k}")) for k, t in enumerate(target)), F.lit(0.0)) / shape.outputs
    return forward(df, weights, shape).groupBy(WORKER).agg(F.avg(square).alias("test_error"))


def mlp_job(df: DataFrame, shape: Shape, *, rule: str = "Q", rate: float = 0.1, max_iter: int = 50, initial: Sequence[float] | None = None, seed: int | None = None, wide: bool | None = None, **more: object) -> IterativeJob:
    """Over (worker_id, features, label or labels [, training boolean]). The first iteration sets the weights.

    Rows whose `training` is false only count for the test error (0 for a worker without such rows). Errors are means over workers. The rule's memory and the number of rows
    of the first step, which scales quick propagation, are in the state, so a resumed job goes on as it would have.
    """
    first = [float(w) for w in initial] if initial is not None else np.random.default_rng(seed).uniform(-1, 1, shape.size).tolist()
    shape.split(first)
    by_batch = shape.size > WIDE if wide is None else wide
    names = [f"g{i}" for i in range(shape.size)]
    test = "training" in df.columns

    def worker(data: DataFrame, state: State | None, context: Context) -> DataFrame | None:
        if state is None:
            return None
        learn = data.where("training") if test else data
        r = (batch_gradients if by_batch else column_gradients)(learn, state["weights"], shape)
        if not test:
            return r.withColumn("test_error", F.lit(0.0))
        return r.join(mean_error(data.where("NOT training"), state["weights"], shape), WORKER, "left").fillna(0.0, ["test_error"])

    def combine(r: DataFrame) -> DataFrame:
        heads = [F.sum("n").alias("n"), F.avg("error").alias("error"), F.avg("test_error").alias("test_error")]
        if not by_batch:
            return r.agg(*heads, *(F.sum(g).alias(g) for g in names))
        total = r.select(F.posexplode("g").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v")).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("all"))
        return r.agg(*heads).join(total, F.lit(True)).select("n", "error", "test_error", F.transform("all", lambda x: x["v"]).alias("g"))

    def master(rows: list, state: State | None, context: Context) -> State:
        if state is None:
            return {"halt": False, "train_error": 0.0, "test_error": 0.0, "train_size": 0, "weights": first, "gradients": [], "memory": {}, "frozen_size": 0}
        if not rows or not rows[0]["n"]:
            raise ValueError("no worker has data")
        r = rows[0]
        g = r["g"] if by_batch else [r[x] for x in names]
        size = state["frozen_size"] or r["n"]
        w, memory = update(rule, state["weights"], g, state["memory"], rate=rate, **({"n_train": size} if rule.upper() == "Q" else {}))
        return {"halt": False, "train_error": r["error"], "test_error": r["test_error"], "train_size": r["n"], "weights": w, "gradients": g, "memory": memory, "frozen_size": size}

    return IterativeJob(df, worker, master, SCHEMA, max_iter=max_iter, combine=combine, **more)
