"""Regression, clustering, update rules, the network, functions and custom workers."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lockstep.functions import scalars, vectors
from lockstep.operators import custom, kmeans, mlp, regression
from lockstep.operators.optim import update
from lockstep.sources.workers import WORKER


@pytest.fixture(scope="module")
def diagonal(spark):
    return spark.createDataFrame([(0, [v, v], v) for v in (0.25, 0.5, 0.75, 1.0)], "worker_id int, features array<double>, label double")


@pytest.mark.parametrize("method", ["scan", "moments"])
def test_linear_steps(diagonal, method):
    r = regression.regression_job(diagonal, 2, rate=0.1, max_iter=20, initial=[0, 0, 0], method=method).run()
    assert r.states[2]["parameters"] == pytest.approx([0.25, 0.1875, 0.1875])
    assert r.states[2]["error"] == pytest.approx(0.234375)
    assert r.states[3]["parameters"] == pytest.approx([0.30625, 0.2421875, 0.2421875])
    assert r.state["parameters"] == pytest.approx([0.18411612416308606, 0.3651259937827862, 0.3651259937827862])
    assert r.state["error"] == pytest.approx(0.003173266681104283)


def test_error_is_a_mean_of_means(spark):
    x = spark.createDataFrame([(0, [0.0], 1.0), (1, [0.0], 3.0), (1, [0.0], 3.0)], "worker_id int, features array<double>, label double")
    assert regression.regression_job(x, 1, rate=0.0, max_iter=2, initial=[0, 0]).run().state["error"] == pytest.approx((0.5 + 4.5) / 2)


@pytest.mark.parametrize("link", ["linear", "logistic"])
def test_wide_models_agree_with_columns(spark, link, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i % 3, rng.random(4).tolist(), float(i % 2)) for i in range(50)]
    x = spark.createDataFrame(rows, "worker_id int, features array<double>, label double").repartition(3)
    run = lambda: regression.regression_job(x, 4, link=link, rate=0.01, max_iter=4, initial=[0.1] * 5, method="scan").run().state
    a = run()
    monkeypatch.setattr(regression, "WIDE", 1)
    b = run()
    assert a["parameters"] == pytest.approx(b["parameters"])
    assert a["error"] == pytest.approx(b["error"])


def test_first_iteration_and_seed(diagonal):
    one = regression.regression_job(diagonal, 2, max_iter=1, seed=3).run().state
    assert one == regression.regression_job(diagonal, 2, max_iter=1, seed=3).run().state
    assert all(0 <= w < 1 for w in one["parameters"])
    with pytest.raises(ValueError):
        regression.regression_job(diagonal, 2, initial=[1.0])
    with pytest.raises(ValueError, match="no worker has data"):
        regression.regression_job(diagonal.limit(0), 2, initial=[0, 0, 0], max_iter=2, method="scan").run()


def points(spark, values, workers=1):
    rows = [(i % workers, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "worker_id int, id bigint, features array<double>")


def test_compat_tags_swap(spark):
    x = points(spark, [[1.0, 0.1], [1.0, 0.2], [0.1, 1.0], [0.2, 1.0]])
    tags = lambda c: [r["tag"] for r in kmeans.assigned(x, c, "compat").orderBy("id").collect()]
    assert tags([[1.0, 0.0], [0.0, 1.0]]) == [1, 1, 0, 0]
    assert tags([[0.0, 1.0], [1.0, 0.0]]) == [0, 0, 1, 1]
    assert tags([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]])[:1] == [2]
    assert [r["tag"] for r in kmeans.assigned(x, [[1.0, 0.0], [0.0, 1.0]], "cosine").orderBy("id").collect()] == [0, 0, 1, 1]


def test_nan_and_zero_vectors(spark):
    x = points(spark, [[0.0, 0.0], [1.0, None], [None, None]])
    for mode in kmeans.MODES:
        assert kmeans.assigned(x, [[1.0, 0.0], [math.nan, math.nan]], mode).agg(F.max("tag")).first()[0] == 0
    assert kmeans.assigned(x, [[math.nan] * 2, [1.0, 0.0]], "cosine").where("id = 1").first()["tag"] == 1


def test_empty_cluster_becomes_nan(spark):
    r = kmeans.kmeans_job(points(spark, [[1.0, 0.0], [2.0, 0.0]]), 2, 2, key="id", max_iter=2, initial=[[1, 0], [0, 1]]).run()
    assert r.state["points"][0] == [1.5, 0.0]
    assert all(map(math.isnan, r.state["points"][1]))
    assert kmeans.tagged(points(spark, [[1.0, 0.0]]), {1: r.states[1]}).first()["tag"] == -1


@pytest.mark.parametrize("block", [5, 100_000])
def test_seeds(spark, block, monkeypatch):
    monkeypatch.setattr(kmeans, "RANKED", block)
    x = points(spark, [[float(i), 0.0] for i in range(23)], 2).repartition(5)
    ranked = kmeans.ranks(x, "id", block).select(WORKER, "id", "__rank", "__n").collect()
    assert all(r["__rank"] == r["id"] // 2 and r["__n"] == 12 - r[WORKER] for r in ranked)
    got = sorted((r[WORKER], r["rank"]) for r in kmeans.seeds(x, 5, "id").collect())
    assert got == [(0, i) for i in range(0, 12, 2)] + [(1, i) for i in range(0, 11, 2)]
    assert kmeans.seeds(x, 50, "id").count() == 23
    assert kmeans.first_centres([[3.0], [1.0], [2.0], [0.0]], 2) == [[0.0], [2.0]]
    with pytest.raises(ValueError, match="fewer than k"):
        kmeans.first_centres([[1.0]], 2)


def scalar_quick(w, g, d, last, rate, n):
    """One weight by the rule's definition."""
    eps, shrink, s, p = 0.35 / n, rate / (1 + rate), 1e-4 * w - g, -last
    if d == 0:
        return -eps * s
    out = -eps * s if (s > 0 if d < 0 else s < 0) else 0.0
    big = s >= shrink * p if d < 0 else s <= shrink * p
    return out + (rate * d if big else d * s / (p - s))


value = st.floats(-5, 5).map(lambda x: round(x, 3))


@settings(max_examples=200, deadline=None)
@given(value, value, value, value)
def test_quick_propagation(w, g, d, last):
    try:
        expected = scalar_quick(w, g, d, last, 0.3, 7)
    except ZeroDivisionError:
        return
    got, memory = update("Q", [w], [g], {"step": [d], "gradient": [last]}, rate=0.3, n_train=7)
    assert got[0] - w == pytest.approx(expected, abs=1e-9)
    assert memory["gradient"] == [g]


def test_resilient():
    w, m = update("R", [0.0, 0.0], [2.0, -1.0], None, rate=0.1)
    assert w == [0.1, -0.1]
    w, m = update("R", w, [1.0, 1.0], m, rate=0.1)
    assert w == pytest.approx([0.22, 0.0])
    assert m["size"] == pytest.approx([0.12, 0.05])
    assert m["gradient"] == [1.0, 0.0]
    _, m = update("R", [0.0], [1.0], {"size": [49.0], "step": [49.0], "gradient": [1.0]}, rate=0)
    assert m["size"] == [50.0]


def test_other_rules():
    assert update("B", [1.0], [2.0], None, rate=0.1)[0] == pytest.approx([1.2])
    assert update("B", [1.0], [2.0], {"step": [1.0]}, rate=0.1, momentum=0.5)[0] == pytest.approx([1.7])
    assert update("M", [1.0, 1.0, 1.0], [2.0, 0.0, -1e-3], None, rate=0.1)[0] == pytest.approx([1.1, 1.0, 0.9])
    assert update("descent", [1.0], [2.0], None, rate=0.1)[0] == pytest.approx([0.8])
    with pytest.raises(NotImplementedError):
        update("S", [1.0], [1.0], None, rate=0.1)
    with pytest.raises(ValueError, match="unknown rule"):
        update("X", [1.0], [1.0], None, rate=0.1)


def test_network_gradient_by_finite_differences(monkeypatch):
    monkeypatch.setattr(mlp, "FLAT_SPOT", 0.0)
    shape, rng = mlp.Shape(3, 2, 2), np.random.default_rng(5)
    w, x, y = rng.normal(size=shape.size), rng.random((6, 3)), rng.random((6, 2))
    error = lambda w: mlp.batch_gradient(shape, w, x, y)[0] * shape.outputs
    g = mlp.batch_gradient(shape, w, x, y)[1]
    for i in range(shape.size):
        step = np.zeros(shape.size)
        step[i] = 1e-6
        assert g[i] == pytest.approx(-(error(w + step) - error(w - step)) / 4e-6, rel=1e-4, abs=1e-7)


def network_rows(spark, n=40):
    rng = np.random.default_rng(2)
    rows = [(i % 3, rng.random(2).tolist(), float(i % 2), i % 5 != 0) for i in range(n)]
    return spark.createDataFrame(rows, "worker_id int, features array<double>, label double, training boolean")


def test_network_columns_equal_batches(spark):
    x, shape = network_rows(spark), mlp.Shape(2, 3)
    run = lambda wide: mlp.mlp_job(x, shape, seed=1, max_iter=4, wide=wide).run().state
    a, b = run(False), run(True)
    assert a["weights"] == pytest.approx(b["weights"])
    assert (a["train_error"], a["test_error"]) == pytest.approx((b["train_error"], b["test_error"]))
    assert a["train_size"] == 32


def test_network_resumes_with_its_memory(spark, tmp_path):
    from lockstep.plans.checkpoint import Checkpoints

    x, shape, c = network_rows(spark), mlp.Shape(2, 2), Checkpoints(f"file://{tmp_path}/n")
    whole = mlp.mlp_job(x, shape, seed=1, max_iter=5).run().state
    mlp.mlp_job(x, shape, seed=1, max_iter=3, checkpoints=c).run()
    assert mlp.mlp_job(x, shape, seed=1, max_iter=5, checkpoints=c).run(resume=True).state["weights"] == pytest.approx(whole["weights"])


def test_parsing(spark):
    line = spark.createDataFrame([("1||x|4",), (None,)], "l string")
    f = scalars.fields(F.col("l"), "|")
    row = line.select(f.alias("f"), scalars.numbers(f, 3).alias("n"), scalars.numbers(f, 3, "default").alias("d"), scalars.numbers(f, 6, "null", "null").alias("m")).where("f IS NOT NULL").first()
    assert row["f"] == ["1", "", "x", "4"]
    assert row["n"] == [1.0, None, None]
    assert row["d"] == [1.0, 0.0, 0.0]
    assert row["m"] == [1.0, None, None, 4.0, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        line.select(scalars.numbers(f, 3, "raise")).collect()
    with pytest.raises(Exception, match="fewer than 9 fields"):
        line.select(scalars.numbers(f, 9, missing="raise")).collect()
    with pytest.raises(Exception, match="not a number"):
        line.select(scalars.parse_or_default(F.col("l"), 0, required=True)).collect()


def test_scalars_and_vectors(spark):
    one = spark.range(1)
    row = one.select(
        scalars.sigmoid(F.lit(-1000.0)).alias("low"), scalars.sigmoid(F.lit(1000.0)).alias("high"), scalars.ratio(F.lit(0.0), F.lit(0.0)).alias("nan"),
        scalars.less(F.lit(1.0), F.lit(math.nan)).alias("less"), scalars.sign(F.lit(-1e-15)).alias("sign"), vectors.cosine(vectors.literal([1, 0]), F.array(F.lit(2.0), F.lit(None).cast("double"))).alias("cos"),
        vectors.cosine(vectors.literal([0, 0]), vectors.literal([1, 0])).alias("zero"), vectors.norm(vectors.literal([3, 4])).alias("norm"), vectors.with_bias(vectors.literal([5])).alias("bias"),
    ).first()
    assert (row["low"], row["high"], row["less"], row["sign"], row["cos"], row["norm"], row["bias"]) == (0.0, 1.0, False, 0, 1.0, 5.0, [1.0, 5.0])
    assert math.isnan(row["nan"])
    assert math.isnan(row["zero"])


def test_python_worker(spark):
    x = spark.createDataFrame([(i % 3, i) for i in range(100)], "worker_id int, value bigint").repartition(4)
    add = lambda b: pd.DataFrame({"value": [b["value"].sum()]})
    assert {r[WORKER]: r["value"] for r in custom.python_worker(x, add, add, "value bigint").collect()} == {w: sum(range(w, 100, 3)) for w in range(3)}
    assert custom.python_worker(x.limit(0), add, add, "value bigint").count() == 0


def test_last_wins_and_merging(spark):
    x = spark.createDataFrame([(0, "a", 1, 10), (0, "a", 2, 20), (1, "a", 1, 30), (0, None, 1, 5)], "worker_id int, k string, at int, v int")
    got = sorted(((r[WORKER], r["k"] or "", r["v"]) for r in custom.last_by_key(x, ["k"], "at").collect()))
    assert got == [(0, "", 5), (0, "a", 20), (1, "a", 30)]
    assert tuple(custom.merge_partials(x.withColumn("v", F.col("v").cast("bigint")), ["v"], 2).first()) == (4, 65)
    assert custom.all_halt(spark.createDataFrame([], "halt boolean")).first()["halt"] is False


def test_stream_drops_late_and_repeated(spark, tmp_path):
    from datetime import datetime, timedelta

    from lockstep.streaming.results import accepted, windowed_sums

    start = datetime(2024, 1, 1)
    schema = "iteration int, worker_id int, ts timestamp, value bigint"
    batches = [[(1, 0, 0, 5), (1, 0, 1, 7), (1, 1, 0, 6)], [(2, 0, 300, 1)], [(2, 0, 301, 1)], [(1, 2, 1, 9), (2, 1, 302, 2)]]  # a watermark holds from the next batch but one
    for i, rows in enumerate(batches):
        spark.createDataFrame([(a, b, start + timedelta(seconds=t), v) for a, b, t, v in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = accepted(stream).writeStream.format("memory").queryName("accepted").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["iteration"], r["worker_id"]) for r in spark.table("accepted").collect())
    assert got == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert windowed_sums(spark.read.parquet(f"{tmp_path}/in/*")).agg(F.sum("value")).first()[0] == 31
