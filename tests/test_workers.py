"""Logical workers from splits, iterations without late workers, the runner's rules, k-means at width."""

import subprocess
import sys
import threading
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lockstep.operators import kmeans, mlp
from lockstep.operators.carry_sum import carry_sum_job, worker_sums
from lockstep.plans.job import IterativeJob
from lockstep.plans.partial import Partial, StragglerError
from lockstep.plans.runner import check, main, run_jobs
from lockstep.sources.readers import read_text, splitting
from lockstep.sources.splits import packed, split_workers, splits, worker_table
from lockstep.sources.workers import WORKER, with_worker_id


def test_splits_have_some_slop(spark, tmp_path):
    for name, size in (("a", 0), ("b", 100), ("c", 109), ("d", 111), ("e", 305), ("f.gz", 1000), ("_SUCCESS", 5)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {}
    for r in splits(spark, f"file://{tmp_path}", 100).collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["start"], r["length"]))
    want = {"b": [(0, 100)], "c": [(0, 109)], "d": [(0, 100), (100, 11)], "e": [(0, 100), (100, 100), (200, 105)], "f.gz": [(0, 1000)]}
    assert {k: sorted(v) for k, v in got.items()} == want
    with pytest.raises(ValueError, match="positive"):
        splits(spark, f"file://{tmp_path}", 0)


@given(st.lists(st.integers(0, 100), max_size=40), st.integers(1, 100))
def test_packing_keeps_within_the_limit(lengths, most):
    bins = packed(lengths, most)
    held = {}
    for n, b in zip(lengths, bins, strict=True):
        held.setdefault(b, []).append(n)
    assert all(sum(v) <= most or len([n for n in v if n]) == 1 for v in held.values())
    half = [sum(v) for v in held.values() if 2 * sum(v) <= most]
    assert len(half) <= 1  # two half-empty bins would have become one


def test_small_files_share_a_worker(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"{i:02}.txt").write_text("".join(f"{i} {j}\n" for j in range(10)))
    table = worker_table(spark, f"file://{tmp_path}", 200, 200).groupBy(WORKER).agg(F.count("*").alias("n")).collect()
    assert [r["n"] for r in table] != [1] * 12
    with split_workers(spark, f"file://{tmp_path}", 200, 200) as rows:
        lines = rows.collect()
    assert len(lines) == 120
    files = {}
    for r in lines:
        files.setdefault(r["value"].split()[0], set()).add(r[WORKER])
    assert all(len(v) == 1 for v in files.values())


def sleepy(worker_id, when):
    def worker(d, s, c):
        out = d.select(WORKER, (F.col("s") + F.lit(s["value"] if s else 0)).alias("value"))
        return out.withColumn("value", F.when((F.col(WORKER) == worker_id) & (F.expr("reflect('java.lang.Thread', 'sleep', 600000L)") == "x"), F.lit(0)).otherwise(F.col("value"))) if when(c.iteration) else out

    return worker


def total(rows, state, context):
    return {"halt": False, "value": sum(r["value"] for r in rows), "n": len(rows)}


def job(spark, workers, when, partial, **more):
    rows = worker_sums(spark.createDataFrame([(w, w) for w in range(workers)], "worker_id int, value bigint"))
    return IterativeJob(rows, sleepy(3, when), total, "halt boolean, value bigint, n int", partial=partial, **more)


def test_goes_on_without_a_sleeping_worker(spark):
    how = Partial(range(20), ratio=0.95, timeout=0.5)
    r = job(spark, 20, lambda t: t == 2, how, max_iter=3).run()
    assert [r.states[t]["n"] for t in (1, 2, 3)] == [20, 19, 20]
    assert how.late == [(2, 3)]
    assert Partial(range(10), ratio=0.5).least == 10
    assert Partial(range(11), ratio=0.5).least == 5
    with pytest.raises(ValueError, match="partial"):
        job(spark, 20, lambda t: False, how, timeout=3.0).run()


def test_stragglers_stop_the_job_if_they_are_needed(spark):
    how = Partial(range(12), ratio=0.95, timeout=0.2, slow=100.0, times=1)
    r = job(spark, 12, lambda t: t == 2, how, max_iter=4).run()
    assert how.stopped == {3}
    assert [r.states[t]["n"] for t in (1, 2, 3, 4)] == [12, 11, 11, 11]
    with pytest.raises(StragglerError):
        job(spark, 12, lambda t: False, Partial(range(12), slow=0.0, times=1), max_iter=3).run()


def test_a_hanging_end_counts_as_done(spark):
    x = spark.createDataFrame([(0, 1), (1, 2)], "worker_id int, value bigint")
    enough = threading.Event()
    done = run_jobs([carry_sum_job(x, 2, None, name="hangs", cleanup=lambda c: enough.wait(60)), carry_sum_job(x, 2, None, name="ends")], patience=0.5)
    enough.set()
    assert {n: r.state["value"] for n, r in done.items()} == {"hangs": 9, "ends": 9}


def test_parts_that_do_not_go_together(spark):
    x = spark.createDataFrame([(0, 1)], "worker_id int, value bigint")
    good = carry_sum_job(x, 1)
    check(good)
    with pytest.raises(ValueError, match="halt"):
        check(IterativeJob(x, good.worker, good.master, "value bigint"))
    with pytest.raises(ValueError, match="halt"):
        check(IterativeJob(x, lambda d, s, c: d, good.master, good.schema, halt_on_all_workers=True))


def csv_worker(data, state, context):
    return data.groupBy(WORKER).agg(F.sum(F.col("_c1").cast("long")).alias("value"))


def csv_master(rows, state, context):
    return {"halt": True, "value": sum(r["value"] for r in rows)}


def test_command_line_reads_any_format(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,1\ny,2\n")
    (tmp_path / "b.csv").write_text("z,4\n")
    r = main(["-i", f"file://{tmp_path}/*.csv", "-inputformat", "csv", "-w", f"{__name__}:csv_worker", "-m", f"{__name__}:csv_master", "-s", "halt boolean, value bigint"])
    assert (r.state["value"], r.iteration) == (7, 1)


def test_launch_script_parses(tmp_path):
    here = Path(__file__).parent.parent
    for script in ("lockstep", "demo-sum"):
        assert subprocess.run(["bash", "-n", here / "bin" / script], check=False).returncode == 0
    fake = tmp_path / "spark-submit"
    fake.write_text('#!/bin/sh\nprintf "%s\\n" "$@"\n')
    fake.chmod(0o755)
    env = {"PATH": f"{tmp_path}:/usr/bin:/bin"}
    out = subprocess.run([here / "bin" / "lockstep", "--master", "yarn", "--", "-i", "x y"], env=env, capture_output=True, text=True, check=True).stdout.split("\n")
    assert out[:2] == ["--master", "yarn"]
    assert out[3:5] == ["-i", "x y"]
    out = subprocess.run([here / "bin" / "demo-sum", "in", "7"], env=env, capture_output=True, text=True, check=True).stdout.split("\n")
    assert out[1:5] == ["-i", "in", "-c", "7"]
    assert sys.version_info


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6))
def test_wide_kmeans_is_the_narrow_one(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [None if rng.random() < 0.1 else float(x) for x in rng.normal(size=5)] if i % 9 else [0.0] * 5) for i in range(60)]
    x = spark.createDataFrame(rows, "id int, features array<double>").withColumn(WORKER, F.lit(0))
    centres = rng.normal(size=(4, 5)).tolist()
    for mode in kmeans.MODES:
        narrow = {r["id"]: r["tag"] for r in kmeans.assigned(x, centres, mode, False).collect()}
        assert {r["id"]: r["tag"] for r in kmeans.assigned(x, centres, mode, True).collect()} == narrow
        sums = {r["tag"]: (r["n"], [r[f"c{j}"] for j in range(5)]) for r in kmeans.cluster_sums(x, centres, mode, by_worker=False).collect()}
        got = {r["tag"]: (r["n"], r["vector"]) for r in kmeans.wide_sums(x, centres, mode).collect()}
        assert {t: n for t, (n, _) in got.items()} == {t: n for t, (n, _) in sums.items()}
        assert all(got[t][1] == pytest.approx(v) for t, (_, v) in sums.items())


def test_wide_kmeans_of_odd_rows(spark):
    x = spark.createDataFrame([(1, [1.0, 2.0, 9.0]), (2, None), (3, []), (4, [1.0])], "id int, features array<double>").withColumn(WORKER, F.lit(0))
    for mode in kmeans.MODES:
        narrow, wide = ({r["id"]: r["tag"] for r in kmeans.assigned(x, [[0.0, 1.0], [2.0, 0.5]], mode, w).collect()} for w in (False, True))
        assert {i: t for i, t in narrow.items() if i != 2} == {i: t for i, t in wide.items() if i != 2}


@pytest.mark.parametrize("kind", ["string", "timestamp", "bigint"])
def test_ranks_of_any_key_without_an_array_of_cuts_for_each_row(spark, kind):
    n = 700
    key = {"string": F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")), "timestamp": F.timestamp_seconds("id"), "bigint": F.col("id")}[kind]
    x = spark.range(n).select(key.alias("key"), (F.col("id") % 3).cast("int").alias(WORKER), F.array(F.col("id").cast("double")).alias("features")).repartition(5)
    got = kmeans.ranks(x, "key", 10)
    assert all(r["features"][0] // 3 == r["__rank"] for r in got.collect())
    groups = kmeans.cuts(x, "key", 70, n)
    assert max(map(len, groups)) <= 9
    assert len(groups) <= 10


def test_several_outputs_by_batches(spark):
    shape = mlp.Shape(2, 3, 2)
    rng = np.random.default_rng(1)
    rows = [(i % 2, rng.random(2).tolist(), rng.random(2).tolist()) for i in range(30)]
    x = spark.createDataFrame(rows, "worker_id int, features array<double>, labels array<double>")
    w = rng.normal(size=shape.size).tolist()
    a = {r[WORKER]: (r["error"], [r[f"g{i}"] for i in range(shape.size)]) for r in mlp.column_gradients(x, w, shape).collect()}
    b = {r[WORKER]: (r["error"], r["g"]) for r in mlp.batch_gradients(x, w, shape).collect()}
    for k, (e, g) in a.items():
        assert b[k][0] == pytest.approx(e)
        assert b[k][1] == pytest.approx(g)


def test_a_file_s_lines_stay_in_many_tasks(spark, tmp_path):
    """However few files there are, and however large Spark thinks that the table of them is."""
    for name in ("b/1", "b/2", "a/1"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("7\n" * 2000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = F.count_distinct("task").alias("tasks")
        with splitting(spark, 500):
            lines = read_text(spark, f"file://{tmp_path}/*", with_file=True)
            got = with_worker_id(lines, file="file").withColumn("task", F.spark_partition_id()).groupBy(WORKER, F.right("file", F.lit(3)).alias("file")).agg(F.count("*").alias("n"), tasks).orderBy(WORKER).collect()
            assert [(r[WORKER], r["file"], r["n"]) for r in got] == [(0, "a/1", 2000), (1, "b/1", 2000), (2, "b/2", 2000)]
            assert min(r["tasks"] for r in got) > 4
        with split_workers(spark, f"file://{tmp_path}/a", 500) as rows:
            assert rows.withColumn("task", F.spark_partition_id()).agg(tasks).first()["tasks"] > 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_worker_for_each_folder(spark, tmp_path):
    for name, value in (("x/1", 1), ("x/2", 2), ("y/1", 4)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"{value}\n")
    here = "lockstep.operators.carry_sum"
    common = ["-i", f"file://{tmp_path}/*", "-w", f"{here}:line_worker", "-m", f"{here}:line_master", "-s", "halt boolean, value bigint", "-c", "2"]
    assert main([*common, "--folders"]).state["value"] == 7 * 2 + 7
    assert main(common).state["value"] == 7 * 3 + 7
    lines = with_worker_id(read_text(spark, f"file://{tmp_path}/*", with_file=True), file="file", folders=True)
    assert sorted((r["value"], r[WORKER]) for r in lines.collect()) == [("1", 0), ("2", 0), ("4", 1)]
    odd = with_worker_id(spark.createDataFrame([("b",), (None,), ("a",)], "file string"), file="file", folders=True)
    assert {r["file"]: r[WORKER] for r in odd.collect()} == {None: 0, "a": 1, "b": 1}


def test_null_file_is_worker_0(spark):
    x = with_worker_id(spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "file string"), file="file")
    assert sorted((r["file"] or "", r[WORKER]) for r in x.collect()) == [("", 0), ("a", 1), ("b", 2), ("b", 2)]
