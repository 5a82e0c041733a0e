"""The loop: sums, halting, hooks, resuming, time limits, runners."""

import time

import pytest
from pyspark.sql import functions as F

from lockstep.operators.carry_sum import carry_sum_job
from lockstep.plans.checkpoint import Checkpoints
from lockstep.plans.hooks import Hook, LogHook, MetricsHook, SinkHook
from lockstep.plans.job import IterativeJob
from lockstep.plans.runner import main, parse, run_jobs
from lockstep.sources.readers import paths, read, read_sequence, read_text, splitting
from lockstep.sources.sinks import write_model, write_network, write_tagged, write_value
from lockstep.sources.workers import WORKER, require_workers, with_worker_id


@pytest.fixture
def six(spark):
    return spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (1, 4)], "worker_id int, value bigint")


@pytest.mark.parametrize(("steps", "expected"), [(1, 15), (2, 45), (10, 15345)])
def test_carry_sum_doubles_for_two_workers(six, steps, expected):
    assert carry_sum_job(six, steps, None).run().state["value"] == expected


def test_carry_sum_halts(six):
    r = carry_sum_job(six, 50).run()
    assert (r.iteration, r.state["value"], r.halted) == (17, 1966065, True)


def test_one_worker_adds_up(six):
    assert carry_sum_job(six.withColumn(WORKER, F.lit(0)), 4, None).run().state["value"] == 60


def test_partitions_do_not_matter(six):
    assert {carry_sum_job(six.repartition(n), 5, None).run().state["value"] for n in (1, 3, 7)} == {15 * 31}


def test_nulls_and_empty(spark, six):
    rows = six.unionByName(spark.createDataFrame([(2, None)], "worker_id int, value bigint"))
    assert carry_sum_job(rows, 2, None).run().state["value"] == 45
    assert carry_sum_job(six.limit(0), 2, None).run().state["value"] == 0


def test_resume_goes_on(six, tmp_path):
    c = Checkpoints(f"file://{tmp_path}/states")
    carry_sum_job(six, 3, None, checkpoints=c).run()
    assert c.iterations(six.sparkSession) == [2, 3]
    r = carry_sum_job(six, 10, None, checkpoints=c).run(resume=True)
    assert r.state["value"] == 15345
    assert min(r.states) == 3
    assert carry_sum_job(six, 10, None, checkpoints=Checkpoints(f"file://{tmp_path}/none")).run(resume=True).state["value"] == 15345


def test_hook_order_and_metrics(six):
    log, metrics = [], MetricsHook()
    carry_sum_job(six, 1, None, system_hooks=(LogHook("s", log),), hooks=(LogHook("u", log), metrics)).run()
    assert [x[0] for x in log] == ["s", "u", "s", "u", "u", "s", "u", "s"]
    assert metrics.frame(six.sparkSession).select("iteration", "results").collect() == [(1, 1)]


def test_after_hooks_all_run_and_the_first_error_counts(six):
    seen = []

    class Bad(Hook):
        def __init__(self, name):
            self.name = name

        def after_application(self, context):
            seen.append(self.name)
            raise ValueError(self.name)

    done = lambda c: c.on_completion(lambda _: seen.append("callback"))
    with pytest.raises(ValueError, match="b"):
        carry_sum_job(six, 1, None, hooks=(Bad("a"), Bad("b")), setup=done).run()
    assert seen == ["callback", "b", "a"]


def test_completion_runs_after_a_failure(six):
    seen = []

    def master(rows, state, context):
        raise RuntimeError("master")

    job = IterativeJob(six, lambda d, s, c: d.agg(F.sum("value").alias("v")), master, "halt boolean", max_iter=2, cleanup=lambda c: seen.append(c.iteration))
    with pytest.raises(RuntimeError, match="master"):
        job.run()
    assert seen == [1]


def test_all_workers_halt(six):
    def job(limit):
        worker = lambda d, s, c: d.groupBy(WORKER).agg((F.sum("value") >= limit).alias("halt"))
        return IterativeJob(six, worker, lambda rows, s, c: {"halt": False}, "halt boolean", max_iter=5, halt_on_all_workers=True).run()

    assert job(6).iteration == 1
    assert job(9).iteration == 5


def test_time_limit(six):
    slow = F.udf(lambda x: time.sleep(20) or x, "bigint")

    def worker(d, s, c):
        return d.select((slow("value") if c.iteration == 2 else F.col("value")).alias("v")).agg(F.sum("v").alias("v"))

    def master(rows, state, context):
        return {"halt": False, "n": len(rows)}

    how = dict(schema="halt boolean, n int", max_iter=2, timeout=4.0)
    assert IterativeJob(six, worker, master, **how).run().state["n"] == 0
    with pytest.raises(TimeoutError):
        IterativeJob(six, worker, master, soft=False, **how).run()


def test_jobs_side_by_side_with_one_retry(six):
    tries = []

    def flaky(rows, state, context):
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError("once")
        return {"halt": True, "value": rows[0]["value"]}

    bad = IterativeJob(six, lambda d, s, c: d.agg(F.sum("value").alias("value")), flaky, "halt boolean, value bigint", name="flaky")
    out = run_jobs([carry_sum_job(six, 2, None, name="sum"), bad])
    assert out["sum"].state["value"] == 45
    assert out["flaky"].state["value"] == 15
    with pytest.raises(ValueError, match="different names"):
        run_jobs([bad, bad])


def line_worker(data, state, context):
    return data.groupBy(WORKER).agg((F.sum(F.col("value").cast("bigint")) + (state["value"] if state else 0)).alias("v"))


def line_master(rows, state, context):
    return {"halt": False, "value": sum(r["v"] for r in rows) + int(context.options.get("plus", 0))}


@pytest.fixture
def two_files(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("1\n2\n3")
    (tmp_path / "in/b.txt").write_text("2\n3\n4\n")
    (tmp_path / "in/_SUCCESS").write_text("x")
    (tmp_path / "in/pig_schema").write_text("x")
    return tmp_path / "in"


def test_command_line(spark, two_files, tmp_path):
    here = __name__ if __name__ != "__main__" else "tests.test_jobs"
    common = ["-i", str(two_files), "-w", f"{here}:line_worker", "-m", f"{here}:line_master", "-s", "halt boolean, value bigint"]
    assert main([*common, "-c", "10", "-o", f"{tmp_path}/out"]).state["value"] == 15345
    assert spark.read.json(f"{tmp_path}/out").first()["value"] == 15345
    assert main([*common, "-c", "1", "-D", "plus=5", "-W", "1"]).state["value"] == 20
    with pytest.raises(SystemExit):
        parse(["-i", "x"])


def test_paths_and_readers(spark, two_files, tmp_path):
    assert paths("a,b{c,d}, e") == ["a", "b{c,d}", "e"]
    assert read_text(spark, str(two_files)).count() == 6
    assert read_text(spark, f"{two_files}/a*,{two_files}/b.txt").count() == 6
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_text(spark, f"{two_files}/none").count()
    spark.range(5).write.parquet(f"{tmp_path}/p")
    assert read(spark, f"{tmp_path}/p").count() == 5
    with splitting(spark, 1, combine=False):
        assert read_text(spark, str(two_files)).rdd.getNumPartitions() >= 4


def test_compressed_text(spark, tmp_path):
    import gzip

    (tmp_path / "x.txt.gz").write_bytes(gzip.compress(b"a\nb\n"))
    assert read_text(spark, str(tmp_path)).count() == 2


def test_sequence_files(spark, tmp_path):
    spark.sparkContext.parallelize([(1, "a"), (2, "b")]).saveAsSequenceFile(f"file://{tmp_path}/s")
    assert sorted(map(tuple, read_sequence(spark, f"file://{tmp_path}/s").collect())) == [("1", "a"), ("2", "b")]
    assert sorted(map(tuple, read_sequence(spark, f"file://{tmp_path}/s", "native").collect())) == [(1, "a"), (2, "b")]
    assert sorted(bytes(r["value"]) for r in read_sequence(spark, f"file://{tmp_path}/s", "binary").collect()) == [b"a", b"b"]
    rows = with_worker_id(read_sequence(spark, f"file://{tmp_path}/s"), 2, ["key"]).select(WORKER, F.length("value").cast("bigint").alias("value"))
    assert carry_sum_job(rows, 1, None).run().state["value"] == 2


def test_workers(spark):
    x = with_worker_id(spark.range(8), 4, "id")
    assert require_workers(x, 4).count() == 8
    with pytest.raises(ValueError, match="no data for workers"):
        require_workers(x.where("worker_id <> 2"), 4)
    assert with_worker_id(spark.sql("SELECT CAST(NULL AS bigint) AS id"), 3, "id").first()[WORKER] == 0
    with pytest.raises(ValueError):
        with_worker_id(x, None)


def test_sinks(spark, six, tmp_path):
    lines = lambda p: [r["value"] for r in spark.read.text(p).collect()]
    sink = SinkHook(lambda c: write_value(c.spark, c.state["value"], f"{tmp_path}/sum"))
    carry_sum_job(six, 10, None, hooks=(sink,)).run()
    assert lines(f"{tmp_path}/sum") == ["15345"]
    write_model(spark, [0.5, 1], f"{tmp_path}/model")
    assert lines(f"{tmp_path}/model") == ["[0.5, 1.0]"]
    write_tagged(spark.createDataFrame([([1.0, None], 2)], "features array<double>, tag int"), f"{tmp_path}/tags")
    assert lines(f"{tmp_path}/tags") == ["1.0|null|2"]
    write_network(spark, {"inputs": 1}, [0.5], f"{tmp_path}/net")
    assert lines(f"{tmp_path}/net") == ['{"inputs": 1, "weights": [0.5]}']
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        write_value(spark, 1, f"{tmp_path}/sum")
