"""Queries of readers, logical workers, sinks and the loop's less common parts.

Each writes what a table gives into the shared folder, reads it back by the operator in question, and returns what DuckDB can tell from the table alone. Queries named `*_raises`
return whether the error came.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars, vectors
from .operators import kmeans, optim
from .operators.carry_sum import carry_sum_job, worker_sums
from .plans.checkpoint import Checkpoints
from .plans.hooks import MetricsHook, SinkHook
from .plans.job import Context, IterativeJob, State
from .plans.partial import Partial
from .plans.runner import main, run_jobs
from .queries import LIMIT, ORACLES, QUERIES, W, customers, kmeans_chain, query, quantities, sum_chain, table
from .sources import sinks
from .sources.readers import read, read_sequence, read_text
from .sources.shared import shared_folder
from .sources.splits import SLOP, split_workers, splits, worker_table
from .sources.workers import WORKER, require_workers, with_worker_id
from .streaming.results import accepted

_LINES = "concat_ws('|', c_custkey::VARCHAR, c_nationkey::VARCHAR, c_mktsegment)"
_DIGEST = "count(*) AS n, sum(c_custkey)::BIGINT AS keys, count(DISTINCT c_mktsegment) AS segments FROM customer"


def scratch(spark: SparkSession) -> str:
    """A folder of this query's own in the shared one."""
    return f"{shared_folder(spark)}/io-{uuid.uuid4().hex}"


def customer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat_ws("|", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), "c_mktsegment").alias("value"))


def digest(lines: DataFrame, column: str = "value") -> DataFrame:
    parts = scalars.fields(F.col(column).cast("string"), "|")
    x = lines.select(F.get(parts, F.lit(0)).cast("long").alias("key"), F.get(parts, F.lit(2)).alias("segment"))
    return x.agg(F.count("*").alias("n"), F.sum("key").alias("keys"), F.count_distinct("segment").alias("segments"))


def raised(spark: SparkSession, call: Callable[[], object]) -> DataFrame:
    try:
        call()
    except Exception:  # noqa: BLE001  that there is one is the result
        return spark.createDataFrame([(True,)], "raised boolean")
    return spark.createDataFrame([(False,)], "raised boolean")


RAISED = "SELECT true AS raised"

# Readers.


def _text_query(codec: str | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = scratch(spark)
        customer_lines(spark, sf_dir).write.text(at, **({"compression": codec} if codec else {}))
        return digest(read_text(spark, at))

    return run


for _name, _codec in (("text_scan", None), ("gzip_text_scan", "gzip"), ("bzip2_text_scan", "bzip2")):
    QUERIES[_name], ORACLES[_name] = _text_query(_codec), f"SELECT {_DIGEST}"


def _sequence(spark: SparkSession, sf_dir: str) -> str:
    at = scratch(spark)
    customer_lines(spark, sf_dir).rdd.map(lambda r: (len(r[0]), r[0])).saveAsSequenceFile(at)
    return at


@query(f"SELECT sum(length({_LINES}))::BIGINT AS key_sum, {_DIGEST}")
def sequence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read_sequence(spark, _sequence(spark, sf_dir), "native")
    return digest(x).join(x.agg(F.sum("key").cast("long").alias("key_sum")), F.lit(True))


@query(f"SELECT sum(length({_LINES}))::BIGINT AS key_sum, {_DIGEST}")
def sequence_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read_sequence(spark, _sequence(spark, sf_dir), "text")
    return digest(x).join(x.agg(F.sum(F.col("key").cast("long")).alias("key_sum")), F.lit(True))


@query(f"SELECT sum(octet_length(encode({_LINES})))::BIGINT AS bytes, {_DIGEST}")
def sequence_as_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read_sequence(spark, _sequence(spark, sf_dir), "binary")
    return digest(x).join(x.agg(F.sum(F.octet_length("value")).cast("long").alias("bytes")), F.lit(True))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def any_format_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One format (CSV) read with options and a schema of the user's."""
    at = scratch(spark)
    table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").write.csv(at, sep=";", header=True)
    x = read(spark, at, "csv", sep=";", header="true").select("c_mktsegment", scalars.parse_strict(F.col("c_acctbal")).alias("v"))
    return x.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query(f"SELECT {_DIGEST} WHERE c_nationkey IN (1, 2, 3, 7)")
def path_lists_and_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    customer_lines(spark, sf_dir).withColumn("nation", F.get(scalars.fields(F.col("value"), "|"), F.lit(1))).write.partitionBy("nation").text(at)
    return digest(read_text(spark, f"{at}/nation={{1,2}}, {at}/nation=[3], {at}/nation=7"))


@query(RAISED)
def missing_path_raises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raised(spark, lambda: read_text(spark, f"{scratch(spark)}/nothing*").count())


@query(f"SELECT {_DIGEST}")
def metadata_files_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    lines = customer_lines(spark, sf_dir)
    for part, rows in (("data", lines), ("pig_schema", lines.limit(3)), ("_hidden", lines.limit(2)), (".hidden", lines.limit(1))):
        rows.write.text(f"{at}/{part}")
    return digest(read_text(spark, f"{at}/*"))


# Logical workers from splits. Lines have 16 bytes, so byte offsets follow from row numbers; a line that begins at a boundary belongs to the split before it.

BLOCK, LINE = 4096, 16
_OFFSETS = f"SELECT c_custkey, {LINE} * (row_number() OVER (ORDER BY c_custkey) - 1) AS o, {LINE} * count(*) OVER () AS size FROM customer"


def _fixed_lines(spark: SparkSession, sf_dir: str, at: str, by_nation: bool = False) -> None:
    x = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.lpad(F.col("c_custkey").cast("string"), LINE - 1, "0").alias("value"))
    if by_nation:
        x.repartition("c_nationkey").select("value", "c_nationkey").write.partitionBy("c_nationkey").text(at)
    else:
        x.orderBy("c_custkey").select("value").coalesce(1).write.text(at)


@query(f"WITH x AS ({_OFFSETS}), n AS (SELECT CASE WHEN max(size) / {BLOCK} <= {SLOP} THEN 1 ELSE ceil(max(size) / {BLOCK} - {SLOP}) + 1 END AS n FROM x) SELECT least(greatest(o - 1, 0) // {BLOCK}, n - 1)::INTEGER AS worker_id, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM x, n GROUP BY 1")
def split_worker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    _fixed_lines(spark, sf_dir, at)
    with split_workers(spark, at, BLOCK) as rows:
        out = rows.groupBy(WORKER).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("keys"))
        return spark.createDataFrame(out.collect(), out.schema)


@query(f"WITH f AS (SELECT {LINE} * count(*) AS size FROM customer GROUP BY c_nationkey) SELECT sum(CASE WHEN size / {BLOCK} <= {SLOP} THEN 1 ELSE ceil(size / {BLOCK} - {SLOP}) + 1 END)::BIGINT AS n_splits, sum(size)::BIGINT AS bytes FROM f")
def uncombined_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    _fixed_lines(spark, sf_dir, at, by_nation=True)
    return splits(spark, f"{at}/*", BLOCK).agg(F.count("*").alias("n_splits"), F.sum("length").alias("bytes"))


@query(f"SELECT sum(c_custkey)::BIGINT AS keys, count(*) AS n, true AS fits, (SELECT count(*) FROM (SELECT {LINE} * count(*) AS size FROM customer GROUP BY c_nationkey) WHERE size > 0) > 1 AS shared FROM customer")
def combined_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small files share workers; no worker of several splits has more bytes than were allowed."""
    at = scratch(spark)
    _fixed_lines(spark, sf_dir, at, by_nation=True)
    bins = worker_table(spark, f"{at}/*", BLOCK, BLOCK).groupBy(WORKER).agg(F.sum("length").alias("bytes"), F.count("*").alias("m"))
    told = bins.agg(F.bool_and((F.col("bytes") <= BLOCK) | (F.col("m") == 1)).alias("fits"), (F.max("m") > 1).alias("shared"))
    with split_workers(spark, f"{at}/*", BLOCK, BLOCK) as rows:
        out = rows.agg(F.sum(F.col("value").cast("long")).alias("keys"), F.count("*").alias("n")).join(told, F.lit(True))
        return spark.createDataFrame(out.collect(), out.schema)


@query("SELECT count(DISTINCT c_nationkey) AS workers, count(*) AS n FROM customer")
def empty_gzip_worker_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    x = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").cast("string").alias("value"))
    x.repartition("c_nationkey").write.partitionBy("c_nationkey").text(f"{at}/full", compression="gzip")
    x.limit(0).select("value").repartition(1).write.text(f"{at}/none", compression="gzip")
    with split_workers(spark, f"{at}/full/*,{at}/none", BLOCK) as rows:
        out = rows.agg(F.count_distinct(WORKER).alias("workers"), F.count("*").alias("n"))
        return spark.createDataFrame(out.collect(), out.schema)


@query(RAISED)
def empty_worker_raises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raised(spark, lambda: require_workers(quantities(spark, sf_dir), W + 1))


@query(sum_chain(2) + " SELECT 2::INTEGER AS iteration, m AS value FROM m2")
def sequence_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carry-sum over a sequence file's values."""
    at = scratch(spark)
    quantities(spark, sf_dir).rdd.map(lambda r: (r[WORKER], str(r["value"]))).saveAsSequenceFile(at)
    x = read_sequence(spark, at, "text").select(F.col("key").cast("int").alias(WORKER), scalars.parse_strict(F.col("value"), "long").alias("value"))
    r = carry_sum_job(x, 2, None).run()
    return spark.createDataFrame([(r.iteration, r.state["value"])], "iteration int, value bigint")


# Parsing at the edges.


@query("SELECT l_linenumber, sum(l_orderkey)::BIGINT AS keys FROM lineitem GROUP BY 1")
def parse_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_orderkey").cast("string").alias("t"))
    return x.groupBy("l_linenumber").agg(F.sum(scalars.parse_strict(F.col("t"), "long")).alias("keys"))


@query(RAISED)
def parse_long_raises(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "customer").select(scalars.parse_strict(F.col("c_name"), "long").alias("v"))
    return raised(spark, lambda: x.agg(F.sum("v")).collect())


@query("SELECT l_linenumber, round(sum(l_quantity), 6) + 0.0 AS f0, round(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_tax ELSE 0 END), 6) + 0.0 AS f1, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS known FROM lineitem GROUP BY 1")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with too few fields: zeros, or nulls where those are asked for."""
    line = F.when(F.col("l_linenumber") % 2 == 0, F.concat_ws("|", F.col("l_quantity").cast("string"), F.col("l_tax").cast("string"))).otherwise(F.col("l_quantity").cast("string"))
    parts = scalars.fields(line, "|")
    x = table(spark, sf_dir, "lineitem").select("l_linenumber", scalars.numbers(parts, 2, "raise").alias("z"), scalars.numbers(parts, 2, "null", "null").alias("u"))
    out = x.groupBy("l_linenumber").agg(F.sum(F.get("z", F.lit(0))).alias("f0"), F.sum(F.get("z", F.lit(1))).alias("f1"), F.count(F.get("u", F.lit(1))).alias("known"))
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("f0", "f1")})


@query(RAISED)
def missing_fields_raise(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(scalars.numbers(scalars.fields(F.col("l_quantity").cast("string"), "|"), 2, "raise", "raise").alias("v"))
    return raised(spark, lambda: x.agg(F.sum(F.get("v", F.lit(0)))).collect())


@query("SELECT c_nationkey % 2 = 0 AS known, round(sum(c_acctbal + CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey ELSE 0 END), 4) + 0.0 AS total FROM customer GROUP BY 1")
def nulls_as_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("c_nationkey") % 2 == 0
    v = vectors.filled(F.array("c_acctbal", F.when(known, F.col("c_nationkey").cast("double"))))
    x = table(spark, sf_dir, "customer").select(known.alias("known"), v.alias("v"))
    return x.groupBy("known").agg((F.round(F.sum(F.get("v", F.lit(0)) + F.get("v", F.lit(1))), 4) + F.lit(0.0)).alias("total"))


# Sinks, read again.


@query(sum_chain(2) + " SELECT m AS value FROM m2")
def value_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    carry_sum_job(quantities(spark, sf_dir), 2, None, hooks=(SinkHook(lambda c: sinks.write_value(spark, c.state["value"], at)),)).run()
    return read_text(spark, at).select(F.col("value").cast("long").alias("value"))


_MODEL = "WITH w AS (SELECT c_nationkey AS idx, round(avg(c_acctbal), 3) AS weight FROM customer GROUP BY 1) SELECT idx::INTEGER AS idx, weight FROM (SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, weight FROM w)"


def _weights(spark: SparkSession, sf_dir: str) -> list[float]:
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 3).alias("w")).orderBy("c_nationkey").collect()
    return [r["w"] for r in rows]


@query(_MODEL)
def model_sink_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    sinks.write_model(spark, _weights(spark, sf_dir), at)
    parts = scalars.fields(F.btrim("value", F.lit("[]")), ", ")
    return read_text(spark, at).select(F.posexplode(F.transform(parts, lambda x: x.cast("double"))).alias("idx", "weight"))


@query(_MODEL)
def model_sink_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    sinks.write_model(spark, _weights(spark, sf_dir), at, "parquet")
    return read(spark, at)


@query(kmeans_chain("SELECT c_custkey AS key, c_custkey % 4 AS worker, [c_acctbal / 1000, c_nationkey::DOUBLE] AS x FROM customer", 3, 2, 3, "cosine") + " SELECT i::INTEGER AS k, round(p[1], 6) + 0.0 AS c0, round(p[2], 6) + 0.0 AS c1 FROM m3")
def centroid_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    state = kmeans.kmeans_job(customers(spark, sf_dir), 3, 2, key="c_custkey", max_iter=3).run().state
    sinks.write_centroids(kmeans.centroid_frame(state, spark), at)
    numbers = F.transform(scalars.fields(F.btrim("value", F.lit("[]")), ", "), lambda x: x.cast("double"))
    rows = read_text(spark, at).select(F.monotonically_increasing_id().cast("int").alias("k"), numbers.alias("v"))
    return rows.select("k", *((F.round(F.get("v", F.lit(j)), 6) + F.lit(0.0)).alias(f"c{j}") for j in range(2)))


@query("SELECT c_nationkey % 3 AS tag, count(*) AS n, count(*) FILTER (WHERE c_custkey % 5 = 0) AS nulls, sum(c_custkey) FILTER (WHERE c_custkey % 5 <> 0)::BIGINT AS keys FROM customer GROUP BY 1")
def tagged_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    x = table(spark, sf_dir, "customer").select(F.array(F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey"))).alias("features"), (F.col("c_nationkey") % 3).alias("tag"))
    sinks.write_tagged(x, at)
    parts = scalars.fields(F.col("value"), "|")
    y = read_text(spark, at).select(F.get(parts, F.lit(0)).alias("f"), F.get(parts, F.lit(1)).cast("int").alias("tag"))
    return y.groupBy("tag").agg(F.count("*").alias("n"), F.count_if(F.col("f") == "null").alias("nulls"), F.sum(F.col("f").try_cast("long")).alias("keys"))


@query(_MODEL.replace("SELECT idx::INTEGER AS idx, weight FROM (", "SELECT 2::INTEGER AS inputs, 3::INTEGER AS hidden, idx::INTEGER AS idx, weight FROM ("))
def network_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    sinks.write_network(spark, {"inputs": 2, "hidden": 3}, _weights(spark, sf_dir), at)
    x = read_text(spark, at).select(F.from_json("value", "inputs int, hidden int, weights array<double>").alias("n"))
    return x.select("n.inputs", "n.hidden", F.posexplode("n.weights").alias("idx", "weight"))


@query(RAISED)
def sink_error_raises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second write to the same place fails, and so does the job."""
    at = scratch(spark)
    hook = SinkHook(lambda c: sinks.write_value(spark, c.state["value"], at))
    return raised(spark, lambda: [carry_sum_job(quantities(spark, sf_dir), 1, None, hooks=(hook,)).run() for _ in range(2)])


@query("SELECT rule, true AS raised FROM (VALUES ('S'), ('X')) AS v(rule)")
def optim_unknown_raises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled conjugate gradient and unknown rules."""
    return raised(spark, lambda: optim.update("S", [0.0], [1.0], rate=0.1)).select(F.lit("S").alias("rule"), "raised").union(raised(spark, lambda: optim.update("X", [0.0], [1.0], rate=0.1)).select(F.lit("X").alias("rule"), "raised"))


# The loop.


@query(f"WITH RECURSIVE s AS (SELECT l_orderkey % {W} AS k, sum(l_quantity::BIGINT)::BIGINT AS s FROM lineitem GROUP BY 1), t AS (SELECT sum(s)::BIGINT AS total, min(s) AS least FROM s), m AS (SELECT 1 AS t, total AS v, least > {LIMIT} AS h FROM t UNION ALL SELECT t + 1, ({W} * v + total)::BIGINT, least + v > {LIMIT} FROM m, t WHERE NOT h AND t < 50) SELECT t::INTEGER AS iteration, v AS value, h AS halted FROM m ORDER BY t DESC LIMIT 1")
def workers_halt_the_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job ends when each worker's own result passes a limit; the master never asks for it."""
    worker = lambda d, s, c: d.select(WORKER, (F.col("s") + F.lit(s["value"] if s else 0)).alias("value")).withColumn("halt", F.col("value") > LIMIT)
    master = lambda rows, s, c: {"halt": False, "value": sum(r["value"] for r in rows)}
    r = IterativeJob(quantities(spark, sf_dir), worker, master, "halt boolean, value bigint", max_iter=50, prepare=worker_sums, halt_on_all_workers=True).run()
    return spark.createDataFrame([(r.iteration, r.state["value"], r.halted)], "iteration int, value bigint, halted boolean")


MANY, LATE = 20, 7


def many_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("value"))
    return worker_sums(with_worker_id(x, MANY, "l_orderkey").select(WORKER, "value"))


def _sleepy(when: Callable[[Context], bool], seconds: int) -> Callable[[DataFrame, State | None, Context], DataFrame]:
    """Carry-sum in which one worker sleeps in some iterations."""

    def worker(d: DataFrame, s: State | None, c: Context) -> DataFrame:
        out = d.select(WORKER, (F.col("s") + F.lit(s["value"] if s else 0)).alias("value"))
        if when(c):
            nap = F.expr(f"reflect('java.lang.Thread', 'sleep', {seconds * 1000}L)")
            out = out.withColumn("value", F.when((F.col(WORKER) == LATE) & (nap == "awake"), F.lit(0)).otherwise(F.col("value")))
        return out

    return worker


def _total(rows: list, state: State | None, context: Context) -> State:
    return {"halt": False, "value": sum(r["value"] for r in rows), "n": len(rows)}


@query(f"WITH s AS (SELECT l_orderkey % {MANY} AS k, sum(l_quantity::BIGINT)::BIGINT AS s FROM lineitem GROUP BY 1), m1 AS (SELECT sum(s)::BIGINT AS m, count(*) AS n FROM s), m2 AS (SELECT sum(s + m)::BIGINT AS m, count(*) AS n FROM s, m1 WHERE k <> {LATE}), m3 AS (SELECT sum(s + m)::BIGINT AS m, count(*) AS n FROM s, m2) SELECT 1::INTEGER AS iteration, m AS value, n::INTEGER AS workers FROM m1 UNION ALL SELECT 2::INTEGER, m, n::INTEGER FROM m2 UNION ALL SELECT 3::INTEGER, m, n::INTEGER FROM m3")
def late_workers_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One worker of 20 sleeps through the second iteration, which goes on without it."""
    how = Partial(range(MANY), ratio=0.95, timeout=0.5)
    job = IterativeJob(many_workers(spark, sf_dir), _sleepy(lambda c: c.iteration == 2, 600), _total, "halt boolean, value bigint, n int", max_iter=3, partial=how)
    return job.run().trace().select("iteration", "value", F.col("n").alias("workers"))


@query(f"SELECT {LATE}::INTEGER AS worker_id, 3::INTEGER AS strikes, 4::INTEGER AS left_out_from")
def stragglers_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worker that was late three times isn't asked again."""
    how = Partial(range(MANY), ratio=0.95, timeout=0.3, edge_timeout=0.3, slow=100.0)
    stopped: list[int] = []
    job = IterativeJob(many_workers(spark, sf_dir), _sleepy(lambda c: True, 600), _total, "halt boolean, value bigint, n int", max_iter=5, partial=how, progress=lambda t, *_: stopped.append(t) if how.stopped else None)
    job.run()
    return spark.createDataFrame([(w, how.strikes[w], stopped[0] + 1) for w in sorted(how.stopped)], f"{WORKER} int, strikes int, left_out_from int")


@query("SELECT t::INTEGER AS iteration, CASE WHEN t = 2 THEN 0 ELSE 20 END::INTEGER AS rows FROM range(1, 4) AS r(t)")
def soft_time_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An iteration over its time gives the master no rows."""
    job = IterativeJob(many_workers(spark, sf_dir), _sleepy(lambda c: c.iteration == 2, 600), _total, "halt boolean, value bigint, n int", max_iter=3, timeout=8.0)
    return job.run().trace().select("iteration", F.col("n").alias("rows"))


@query("SELECT t::INTEGER AS iteration FROM (VALUES (4), (5)) AS v(t)")
def states_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Checkpoints(f"{scratch(spark)}/states", retain=2)
    carry_sum_job(quantities(spark, sf_dir), 5, None, checkpoints=folder).run()
    return spark.createDataFrame([(t,) for t in folder.iterations(spark)], "iteration int")


@query("SELECT t::INTEGER AS iteration, 3::INTEGER AS total, 'running' AS status FROM range(1, 4) AS r(t)")
def progress_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    said: list[tuple[int, int, str]] = []
    carry_sum_job(quantities(spark, sf_dir), 3, None, progress=lambda *x: said.append(x)).run()
    return spark.createDataFrame(said, "iteration int, total int, status string")


@query("SELECT t::INTEGER AS iteration, 1::BIGINT AS results, false AS halted, true AS timed, true AS worked, true AS remembered FROM range(1, 4) AS r(t)")
def iteration_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, and whether times, the tasks' work and memory were measured."""
    hook = MetricsHook()
    carry_sum_job(quantities(spark, sf_dir), 3, None, hooks=(hook,)).run()
    x = hook.frame(spark)
    return x.select("iteration", "results", "halted", (F.col("seconds") > 0).alias("timed"), ((F.col("tasks") > 0) & (F.col("task_ms") >= 0) & (F.col("task_gc_ms") >= 0)).alias("worked"), (F.col("used_mb") > 0).alias("remembered"))


@query(sum_chain(3) + " SELECT name, CASE name WHEN 'flaky' THEN m2.m ELSE m3.m END AS value, CASE name WHEN 'flaky' THEN 2 ELSE 1 END::INTEGER AS tries FROM m2, m3, (VALUES ('flaky'), ('steady'), ('hanging')) AS v(name)")
def parallel_jobs_with_a_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three jobs at once: one fails at first, one never comes to its end though its result stands."""
    tries = {"flaky": 0, "steady": 0, "hanging": 0}
    enough = threading.Event()

    def counted(name: str) -> Callable[[Context], None]:
        def setup(context: Context) -> None:
            tries[name] += 1
            if name == "flaky" and tries[name] == 1:
                raise RuntimeError("first try")

        return setup

    rows = quantities(spark, sf_dir)
    jobs = [carry_sum_job(rows, 2 if n == "flaky" else 3, None, name=n, setup=counted(n), **({"cleanup": lambda c: enough.wait(60)} if n == "hanging" else {})) for n in tries]
    done = run_jobs(jobs, patience=1.0)
    enough.set()
    return spark.createDataFrame([(n, r.state["value"], tries[n]) for n, r in done.items()], "name string, value bigint, tries int")


@query(sum_chain(3) + " SELECT 3::INTEGER AS iteration, m AS value FROM m3")
def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job by the command line's arguments: a worker for each folder, into which every task that reads the table writes a file."""
    at = scratch(spark)
    quantities(spark, sf_dir).select(WORKER, F.col("value").cast("string")).write.partitionBy(WORKER).text(at)
    here = "lockstep.operators.carry_sum"
    r = main(["-i", f"{at}/{WORKER}=*", "--folders", "-w", f"{here}:line_worker", "-m", f"{here}:line_master", "-s", "halt boolean, value bigint", "-c", "3"])
    return spark.createDataFrame([(r.iteration, r.state["value"])], "iteration int, value bigint")


# Results as a stream.


@query("SELECT user_id AS iteration, count(DISTINCT event_type) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1 UNION ALL SELECT -1, 1")
def late_results_in_a_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results arrive one batch of files after the other: some results twice, one from hours later (twice, as what is late is told by the batch before), then such as are late by then."""
    at = scratch(spark)
    x = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("iteration"), F.col("event_type").alias("worker_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id"))
    first = x.where("event_id % 2 = 0").drop("event_id")
    later = x.agg((F.max("ts") + F.expr("INTERVAL 3 HOURS")).alias("ts")).select(F.lit(-1).cast("long").alias("iteration"), F.lit("end").alias("worker_id"), "ts")
    for name, rows in (("a", first.union(first)), ("b", later), ("c", later), ("d", x.drop("event_id"))):
        rows.write.parquet(f"{at}/in/{name}")
        stream = spark.readStream.schema(first.schema).parquet(f"{at}/in/*")
        run = accepted(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("iteration").agg(F.count("*").alias("n"))
