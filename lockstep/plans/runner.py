"""Several jobs over one session, and a command line for one job.

    python -m lockstep.plans.runner -i PATH -w MODULE:WORKER -m MODULE:MASTER -s "halt boolean, value bigint" [-c 50] [-n NAME] [-W 4 | --folders] [-inputformat text] [-D key=value]...
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Sequence
from concurrent.futures import Future, ThreadPoolExecutor, TimeoutError, wait

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from ..sources.readers import read, read_text
from ..sources.workers import require_workers, with_worker_id
from .job import Context, IterativeJob, Result


def run_jobs(jobs: Sequence[IterativeJob], retries: int = 1, at_once: int = 4, patience: float = 120.0) -> dict[str, Result | BaseException]:
    """Runs the jobs side by side; one that fails is run again up to `retries` times, from its checkpoint if it has one. Names must differ.

    A job whose result stands, but which doesn't come to its end within `patience` seconds from then on, counts as done.
    """
    names = [j.name for j in jobs]
    if len({*names}) < len(names):
        raise ValueError("jobs need different names")
    stands: dict[str, Future[Result]] = {n: Future() for n in names}

    def attempt(job: IterativeJob) -> Result | BaseException:
        for left in range(retries, -1, -1):
            try:
                return job.run(resume=left < retries and job.checkpoints is not None, on_result=lambda r: stands[job.name].done() or stands[job.name].set_result(r))
            except Exception as e:  # noqa: BLE001  returned to the caller
                if not left:
                    return e
        raise AssertionError("unreachable")

    def outcome(name: str, end: Future) -> Result | BaseException:
        wait([end, stands[name]], return_when="FIRST_COMPLETED")
        try:
            return end.result(timeout=patience)
        except TimeoutError:
            return stands[name].result()

    pool = ThreadPoolExecutor(max_workers=at_once)
    try:
        ends = {j.name: pool.submit(inheritable_thread_target(j.data.sparkSession)(attempt), j) for j in jobs}
        return {n: outcome(n, f) for n, f in ends.items()}
    finally:
        pool.shutdown(wait=False)


def check(job: IterativeJob) -> None:
    """Raises if the job's parts don't go together; nothing is run. The state needs a boolean halt, and workers whose halt is asked for must have one, too."""
    state = StructType.fromDDL(job.schema)
    if "halt" not in state.fieldNames() or state["halt"].dataType.simpleString() != "boolean":
        raise ValueError("the state's schema needs a boolean halt")
    plan = job.worker(job.prepare(job.data) if job.prepare else job.data, None, Context(job.data.sparkSession, job.name, job.max_iter, job.options, iteration=1))
    if plan is None:
        return
    halts = dict(plan.dtypes).get("halt") == "boolean"
    if job.halt_on_all_workers and not halts:
        raise ValueError("workers have no boolean halt, but the job ends when all want to")


def load(name: str) -> object:
    """The object that "module:name" stands for."""
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute or "", None)
    if not callable(found):
        raise ValueError(f"{name} is not a callable; write module:name")
    return found


def parse(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lockstep")
    p.add_argument("-i", "--input", required=True, help="comma-separated paths or globs of text files")
    p.add_argument("-w", "--worker", required=True, help="module:function")
    p.add_argument("-m", "--master", required=True, help="module:function")
    p.add_argument("-s", "--schema", required=True, help="schema of the state")
    p.add_argument("-c", "--iterations", type=int, default=50)
    p.add_argument("-n", "--name", default="iterative")
    each = p.add_mutually_exclusive_group()
    each.add_argument("-W", "--workers", type=int, help="logical workers; without it one for each file")
    each.add_argument("--folders", action="store_true", help="a logical worker for each folder of files, such as Spark writes, in place of each file")
    p.add_argument("-o", "--output", help="where the last state goes, as JSON")
    p.add_argument("-inputformat", "--input-format", default="text", help="text, or any format that Spark reads")
    p.add_argument("--halt-on-all-workers", action="store_true", help="end when every worker's row says halt")
    p.add_argument("-D", dest="options", action="append", default=[], metavar="KEY=VALUE")
    args = p.parse_args(argv)
    if bad := [o for o in args.options if "=" not in o]:
        p.error(f"-D takes key=value, not {bad[0]}")
    args.options = dict(o.split("=", 1) for o in args.options)
    return args


def main(argv: Sequence[str] | None = None) -> Result:
    args = parse(argv)
    spark = SparkSession.builder.appName(args.name).getOrCreate()
    lines = read_text(spark, args.input, with_file=True) if args.input_format == "text" else read(spark, args.input, args.input_format, with_file=True)
    columns = [c for c in lines.columns if c != "file"]
    data = with_worker_id(lines, args.workers, ["file", *columns]) if args.workers else with_worker_id(lines, file="file", folders=args.folders)
    if args.workers:
        data = require_workers(data, args.workers)
    job = IterativeJob(data, load(args.worker), load(args.master), args.schema, max_iter=args.iterations, name=args.name, options=args.options, halt_on_all_workers=args.halt_on_all_workers)
    check(job)
    result = job.run()
    if args.output:
        result.frame().coalesce(1).write.mode("overwrite").json(args.output)
    return result


if __name__ == "__main__":
    print(main().state)
