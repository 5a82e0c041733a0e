"""The registered queries of the engine's own operators, and DuckDB SQL for the same rows.

SQL for iterative algorithms is an unrolled chain of common table expressions, one for each iteration.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars, vectors
from .operators import custom, kmeans, mlp, regression
from .operators.carry_sum import carry_sum_job, worker_sums, worker_totals
from .operators.optim import update
from .plans.checkpoint import Checkpoints
from .plans.hooks import LogHook
from .plans.job import Context, IterativeJob, State
from .sources.shared import shared_folder
from .sources.workers import WORKER, tag_source, with_worker_id
from .streaming.results import accepted, windowed_sums

W = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Rounded to 6 digits; a negative zero becomes zero."""
    return df.withColumns({n: F.round(F.col(n), 6) + F.lit(0.0) for n in names})


# Carry-sum.


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("value"))
    return with_worker_id(x, W, "l_orderkey").select(WORKER, "value")


def sum_chain(steps: int) -> str:
    head = f"WITH d AS (SELECT (l_orderkey % {W})::INTEGER AS worker_id, l_quantity::BIGINT AS v FROM lineitem), s AS (SELECT worker_id, sum(v)::BIGINT AS s FROM d GROUP BY 1), m0 AS (SELECT 0::BIGINT AS m)"
    return head + "".join(f", r{t} AS (SELECT worker_id, (s + m)::BIGINT AS r FROM s, m{t - 1}), m{t} AS (SELECT sum(r)::BIGINT AS m FROM r{t})" for t in range(1, steps + 1))


@query(sum_chain(3) + " SELECT 3::INTEGER AS iteration, m AS value FROM m3")
def carry_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = carry_sum_job(quantities(spark, sf_dir), 3, None).run()
    return spark.createDataFrame([(r.iteration, r.state["value"])], "iteration int, value bigint")


LIMIT = 1_000_000_000


@query(f"WITH RECURSIVE s AS (SELECT sum(l_quantity::BIGINT)::BIGINT AS s FROM lineitem), m AS (SELECT 1 AS t, s AS v FROM s UNION ALL SELECT t + 1, ({W} * v + s)::BIGINT FROM m, s WHERE v <= {LIMIT} AND t < 50) SELECT t::INTEGER AS iteration, v AS value, v > {LIMIT} AS halted FROM m ORDER BY t DESC LIMIT 1")
def carry_sum_halt(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = carry_sum_job(quantities(spark, sf_dir), 50, LIMIT).run()
    return spark.createDataFrame([(r.iteration, r.state["value"], r.halted)], "iteration int, value bigint, halted boolean")


@query(sum_chain(2) + " SELECT worker_id, r AS value FROM r2")
def worker_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantities(spark, sf_dir)
    return worker_totals(worker_sums(rows), carry_sum_job(rows, 1, None).run().state)


@query(sum_chain(3) + " SELECT 3::INTEGER AS iteration, m AS value FROM m3")
def python_worker_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    add = lambda b: pd.DataFrame({"value": [b["value"].sum()]})

    def worker(data: DataFrame, state: State | None, context: Context) -> DataFrame:
        before = state["value"] if state else 0
        return custom.python_worker(data, add, add, "value bigint").select((F.col("value") + before).alias("value"))

    def master(rows: list, state: State | None, context: Context) -> State:
        return {"halt": False, "value": sum(r["value"] for r in rows)}

    r = IterativeJob(quantities(spark, sf_dir), worker, master, "halt boolean, value bigint", max_iter=3).run()
    return spark.createDataFrame([(r.iteration, r.state["value"])], "iteration int, value bigint")


@query(sum_chain(4) + " SELECT 4::INTEGER AS iteration, m AS value FROM m4")
def resume_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two iterations, then two more by a second job that starts from the first one's checkpoint."""
    folder = Checkpoints(f"{shared_folder(spark)}/states-{uuid.uuid4().hex}")
    rows = quantities(spark, sf_dir)
    carry_sum_job(rows, 2, None, checkpoints=folder).run()
    r = carry_sum_job(rows, 4, None, checkpoints=folder).run(resume=True)
    return spark.createDataFrame([(r.iteration, r.state["value"])], "iteration int, value bigint")


# Regression.


def labelled(spark: SparkSession, sf_dir: str, label: Column) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("features"), label.alias("label"))
    return with_worker_id(x, W, "l_orderkey").select(WORKER, "features", "label")


def _linear(spark: SparkSession, sf_dir: str, **how: object) -> IterativeJob:
    rows = labelled(spark, sf_dir, F.col("l_extendedprice") / 100000)
    n = table(spark, sf_dir, "lineitem").count()
    return regression.regression_job(rows, 2, rate=0.5 / n, max_iter=6, initial=[0.0, 0.0, 0.0], **how)


def _logistic(spark: SparkSession, sf_dir: str) -> IterativeJob:
    rows = labelled(spark, sf_dir, (F.col("l_returnflag") == "R").cast("double"))
    n = table(spark, sf_dir, "lineitem").count()
    return regression.regression_job(rows, 2, link="logistic", rate=0.5 / n, max_iter=6, initial=[0.0, 0.0, 0.0])


def regression_chain(label: str, logistic: bool, steps: int) -> str:
    z = "w0 + w1 * x1 + w2 * x2"
    p = f"1 / (1 + exp(-({z})))" if logistic else z
    sql = f"WITH d AS (SELECT l_orderkey % {W} AS k, l_quantity / 50 AS x1, l_discount * 10 AS x2, {label} AS y FROM lineitem), c AS (SELECT count(*) AS n FROM d), w1 AS (SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS error)"
    for t in range(2, steps + 1):
        sql += f", g{t} AS (SELECT k, avg(e * e / 2) AS error, sum(e) AS g0, sum(e * x1) AS g1, sum(e * x2) AS g2 FROM (SELECT k, x1, x2, {p} - y AS e FROM d, w{t - 1}) GROUP BY k)"
        sql += f", w{t} AS (SELECT any_value(w0) - 0.5::DOUBLE / any_value(n) * sum(g0) AS w0, any_value(w1) - 0.5::DOUBLE / any_value(n) * sum(g1) AS w1, any_value(w2) - 0.5::DOUBLE / any_value(n) * sum(g2) AS w2, avg(g{t}.error) AS error FROM g{t}, w{t - 1}, c)"
    return sql


def _model(spark: SparkSession, weights: Sequence[float]) -> DataFrame:
    return rounded(spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "idx int, weight double"), "weight")


_WEIGHTS = " SELECT i::INTEGER AS idx, round(CASE i WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END, 6) + 0.0 AS weight FROM w6, range(3) AS r(i)"
_PRICE, _FLAG = "l_extendedprice / 100000", "(l_returnflag = 'R')::INT::DOUBLE"


@query(regression_chain(_PRICE, False, 6) + _WEIGHTS)
def linreg_gd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, _linear(spark, sf_dir, method="moments").run().state["parameters"])


@query(regression_chain(_PRICE, False, 6) + _WEIGHTS)
def linreg_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, _linear(spark, sf_dir).run().state["parameters"])


_TRACE = " UNION ALL ".join(f"SELECT {t}::INTEGER AS iteration, round(error, 6) + 0.0 AS error FROM w{t}" for t in range(1, 7))


@query(regression_chain(_PRICE, False, 6) + " " + _TRACE)
def linreg_error_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_linear(spark, sf_dir).run().trace().select("iteration", "error"), "error")


@query(regression_chain(_FLAG, True, 6) + _WEIGHTS)
def logreg_gd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, _logistic(spark, sf_dir).run().state["parameters"])


@query(regression_chain(_FLAG, True, 6) + " SELECT y AS label, count(*) AS n, round(avg(1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2)))), 6) + 0.0 AS mean_prediction FROM d, w6 GROUP BY y")
def logreg_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = _logistic(spark, sf_dir)
    scored = regression.predictions(job.data, job.run().state["parameters"], "logistic")
    return rounded(scored.groupBy("label").agg(F.count("*").alias("n"), F.avg("prediction").alias("mean_prediction")), "mean_prediction")


# k-means.


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("features"))
    return with_worker_id(x, W, "c_custkey")


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("features"))
    return with_worker_id(x, W, "vec_id")


_CUSTOMERS = f"SELECT c_custkey AS key, c_custkey % {W} AS worker, [c_acctbal / 1000, c_nationkey::DOUBLE] AS x FROM customer"
_VECS = f"SELECT vec_id AS key, vec_id % {W} AS worker, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings"


def kmeans_chain(source: str, k: int, c: int, steps: int, mode: str) -> str:
    dot = lambda a, b: f"list_dot_product({a}, {b})"
    sql = f"WITH d AS ({source}), a0 AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY key) - 1 AS rn, count(*) OVER (PARTITION BY worker) AS n FROM d)"
    sql += f", seeds AS (SELECT worker, rn, x FROM a0 WHERE n <= {k} OR rn % greatest(n // {k}, 1) = 0)"
    sql += f", o AS (SELECT x, row_number() OVER (ORDER BY sqrt({dot('x', 'x')}), worker, rn) - 1 AS i, count(*) OVER () AS n FROM seeds)"
    sql += f", m1 AS (SELECT i // (n // {k}) AS i, x AS p FROM o WHERE i % (n // {k}) = 0 AND i // (n // {k}) < {k})"
    for t in range(2, steps + 1):
        before = f"m{t - 1}"
        if mode == "euclidean":
            value = " + ".join(f"(x[{j}] - p[{j}]) * (x[{j}] - p[{j}])" for j in range(1, c + 1))
        else:
            length = f"(sqrt({dot('x', 'x')}) * sqrt({dot('p', 'p')}))"
            value = f"CASE WHEN {length} = 0 THEN 'NaN'::DOUBLE ELSE {dot('x', 'p')} / {length} END"
        sql += f", s{t} AS (SELECT key, x, i, {value} AS s FROM d, {before})"
        if mode == "compat":
            sql += f", t{t} AS (SELECT key, any_value(x) AS x, coalesce(max(i) FILTER (WHERE i > 0 AND s < s0 AND NOT isnan(s) AND NOT isnan(s0)), 0) AS tag FROM (SELECT *, max(s) FILTER (WHERE i = 0) OVER (PARTITION BY key) AS s0 FROM s{t}) GROUP BY key)"
        else:
            order = "ASC" if mode == "euclidean" else "DESC"
            worst = "'Infinity'::DOUBLE" if mode == "euclidean" else "'-Infinity'::DOUBLE"
            sql += f", t{t} AS (SELECT key, x, i AS tag FROM s{t} QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE WHEN isnan(s) THEN {worst} ELSE s END {order}, i) = 1)"
        means = ", ".join(f"sum(x[{j}]) / count(*)" for j in range(1, c + 1))
        nans = ", ".join(["'NaN'::DOUBLE"] * c)
        sql += f", m{t} AS (SELECT i, coalesce(p, [{nans}]) AS p FROM range({k}) AS r(i) LEFT JOIN (SELECT tag, [{means}] AS p FROM t{t} GROUP BY tag) ON tag = i)"
    return sql


def _coordinates(c: int) -> str:
    return ", ".join(f"round(p[{j}], 6) + 0.0 AS c{j - 1}" for j in range(1, c + 1))


def _centres(state: State, spark: SparkSession, c: int) -> DataFrame:
    x = kmeans.centroid_frame(state, spark).select("k", *(F.get("coords", F.lit(j)).alias(f"c{j}") for j in range(c)))
    return rounded(x, *(f"c{j}" for j in range(c)))


def _run_kmeans(spark: SparkSession, sf_dir: str, mode: str, steps: int = 4) -> tuple[IterativeJob, dict[int, State]]:
    job = kmeans.kmeans_job(customers(spark, sf_dir), 3, 2, key="c_custkey", mode=mode, max_iter=steps)
    return job, job.run().states


@query(kmeans_chain(_CUSTOMERS, 3, 2, 1, "compat") + " SELECT worker::INTEGER AS worker_id, rn AS rank, round(x[1], 6) + 0.0 AS c0, round(x[2], 6) + 0.0 AS c1 FROM seeds")
def kmeans_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = kmeans.seeds(customers(spark, sf_dir), 3, "c_custkey")
    return rounded(x.select(WORKER, F.col("rank").cast("long").alias("rank"), F.get("point", F.lit(0)).alias("c0"), F.get("point", F.lit(1)).alias("c1")), "c0", "c1")


def _kmeans_query(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        states = _run_kmeans(spark, sf_dir, mode)[1]
        return _centres(states[max(states)], spark, 2)

    return run


for _mode in kmeans.MODES:
    QUERIES[f"kmeans_{_mode}"] = _kmeans_query(_mode)
    ORACLES[f"kmeans_{_mode}"] = kmeans_chain(_CUSTOMERS, 3, 2, 4, _mode) + f" SELECT i::INTEGER AS k, {_coordinates(2)} FROM m4"


@query(kmeans_chain(_CUSTOMERS, 3, 2, 4, "compat") + " SELECT tag::INTEGER AS tag, count(*) AS n FROM t4 GROUP BY tag")
def kmeans_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    job, states = _run_kmeans(spark, sf_dir, "compat")
    return kmeans.tagged(job.data, states, "compat").groupBy("tag").agg(F.count("*").alias("n"))


@query(kmeans_chain(_VECS, 8, 64, 4, "cosine") + f" SELECT i::INTEGER AS k, {_coordinates(64)} FROM m4")
def kmeans_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = kmeans.kmeans_job(vecs(spark, sf_dir), 8, 64, key="vec_id", max_iter=4).run()
    return _centres(r.state, spark, 64)


# Parsing and scalar functions.

_LINE = "concat_ws('|', l_quantity::VARCHAR, l_discount::VARCHAR, CASE WHEN l_linenumber % 3 = 0 THEN 'bad' ELSE l_tax::VARCHAR END, l_returnflag)"


def lines(spark: SparkSession, sf_dir: str, bad: bool) -> DataFrame:
    tax = F.col("l_tax").cast("string")
    tax = F.when(F.col("l_linenumber") % 3 == 0, "bad").otherwise(tax) if bad else tax
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("|", F.col("l_quantity").cast("string"), F.col("l_discount").cast("string"), tax, "l_returnflag").alias("line"))


def _parsed(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    x = lines(spark, sf_dir, how != "raise").select("l_linenumber", scalars.numbers(scalars.fields(F.col("line"), "|"), 3, how).alias("v"))
    x = x.select("l_linenumber", *(F.get("v", F.lit(i)).alias(f"f{i}") for i in range(3)))
    out = x.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count("f2").alias("n_f2"), *(F.sum(f"f{i}").alias(f"f{i}") for i in range(3)))
    return rounded(out, "f0", "f1", "f2")


def _parse_sql(third: str) -> str:
    return f"SELECT l_linenumber, count(*) AS n, count({third}) AS n_f2, round(sum(l_quantity), 6) + 0.0 AS f0, round(sum(l_discount), 6) + 0.0 AS f1, round(sum({third}), 6) + 0.0 AS f2 FROM (SELECT *, string_split({_LINE}, '|')[3] AS t FROM lineitem) GROUP BY 1"


@query(_parse_sql("l_tax"))
def parse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "raise")


@query(_parse_sql("coalesce(try_cast(t AS DOUBLE), 0)"))
def parse_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "default")


@query(_parse_sql("try_cast(t AS DOUBLE)"))
def parse_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "null")


_EMB = "SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings"


def doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))


@query(f"SELECT vec_id, 5 AS n, 1.0::DOUBLE AS b0, round(e[1], 6) + 0.0 AS b1, round(e[4], 6) + 0.0 AS b4 FROM ({_EMB})".replace("5 AS n", "5::INTEGER AS n"))
def bias_and_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = doubles(spark, sf_dir).select("vec_id", vectors.with_bias(F.slice("e", 1, 4)).alias("v"))
    return rounded(x.select("vec_id", F.size("v").alias("n"), *(F.get("v", F.lit(i)).alias(f"b{i}") for i in (0, 1, 4))), "b0", "b1", "b4")


@query(f"WITH d AS ({_EMB}), r AS (SELECT e AS f FROM d WHERE vec_id = (SELECT min(vec_id) FROM d)) SELECT vec_id, round(list_dot_product(e, f), 6) + 0.0 AS dot, round(list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f))), 6) + 0.0 AS cosine, round(sqrt(list_dot_product(e, e)), 6) + 0.0 AS norm FROM d, r")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = doubles(spark, sf_dir)
    first = vectors.literal(x.orderBy("vec_id").first()["e"])
    return rounded(x.select("vec_id", vectors.dot(F.col("e"), first).alias("dot"), vectors.cosine(F.col("e"), first).alias("cosine"), vectors.norm(F.col("e")).alias("norm")), "dot", "cosine", "norm")


@query("SELECT o_orderkey % 2 = 0 AS training, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scalars.with_training(table(spark, sf_dir, "orders"), F.col("o_orderkey") % 2 == 0)
    return x.groupBy("training").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT substr(md5('1:' || o_orderkey), 1, 8) < '80000000' AS training, count(*) AS n FROM orders GROUP BY 1")
def hashed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(scalars.in_training(F.col("o_orderkey"), 0.5, seed=1).alias("training")).agg(F.count("*").alias("n"))


@query("SELECT copy::INTEGER AS copy, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer, range(3) AS r(copy) GROUP BY 1")
def record_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "customer").select("c_acctbal", F.explode(scalars.copies(3)).alias("copy"))
    return x.groupBy("copy").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT event_type, sum(CASE WHEN abs(value - 50) < 1e-13 THEN 0 WHEN value > 50 THEN 1 ELSE -1 END)::BIGINT AS signs, round(sum(1 / (1 + exp(-(value - 50) / 10))), 6) AS squashed FROM events GROUP BY 1")
def signs_and_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") - 50
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(scalars.sign(v)).alias("signs"), F.round(F.sum(scalars.sigmoid(v / 10)), 6).alias("squashed"))


# Update rules: the weights chase the mean and the mean square of a column.

RATE, STEPS = 0.3, 6


def chase(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("v"))
    rows = with_worker_id(x, W, "event_id")
    n = rows.count()

    def worker(data: DataFrame, state: State | None, context: Context) -> DataFrame | None:
        if state is None:
            return None
        a, b = state["weights"]
        return data.groupBy(WORKER).agg(*(F.sum(e / n).alias(g) for e, g in ((F.col("v") - a, "g0"), (F.col("v") * F.col("v") - b, "g1"))))

    def master(got: list, state: State | None, context: Context) -> State:
        if state is None:
            return {"halt": False, "weights": [0.0, 1.0], "memory": {}}
        g = [sum(r[c] for r in got) for c in ("g0", "g1")]
        w, memory = update(rule, state["weights"], g, state["memory"], rate=RATE, **({"n_train": 1.0} if rule == "Q" else {}))
        return {"halt": False, "weights": w, "memory": memory}

    r = IterativeJob(rows, worker, master, "halt boolean, weights array<double>, memory map<string,array<double>>", max_iter=STEPS + 1).run()
    return _model(spark, r.state["weights"])


def chase_sql(step: str, size: str = "z", gradient: str = "g") -> str:
    """step: SQL of the step from w, g and what is remembered: d (last step), l (last gradient), z (size). size and gradient: what z and l become."""
    sql = "WITH v AS (SELECT avg(value / 100) AS a, avg(value / 100 * value / 100) AS b FROM events), x0 AS (SELECT 0 AS i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS d, 0.0::DOUBLE AS l, 0.1::DOUBLE AS z UNION ALL SELECT 1, 1.0, 0.0, 0.0, 0.1)"
    for t in range(1, STEPS + 1):
        sql += f", y{t} AS (SELECT *, CASE i WHEN 0 THEN a ELSE b END - w AS g FROM x{t - 1}, v)"
        sql += f", u{t} AS (SELECT *, CASE WHEN abs(g * l) < 1e-13 THEN 0 ELSE sign(g * l) END AS c, CASE WHEN abs(g) < 1e-13 THEN 0 ELSE sign(g) END AS sg FROM y{t}), k{t} AS (SELECT *, {size} AS z2 FROM u{t}), q{t} AS (SELECT *, {step} AS e FROM k{t})"
        sql += f", x{t} AS (SELECT i, w + e AS w, e AS d, {gradient} AS l, z2 AS z FROM q{t})"
    return sql + f" SELECT i::INTEGER AS idx, round(w, 6) + 0.0 AS weight FROM x{STEPS}"


_S = "(1e-4::DOUBLE * w - g)"
_LINEAR = f"-0.35::DOUBLE * {_S}"
_CURVED = f"d * {_S} / CASE WHEN -l - {_S} = 0 THEN NULL ELSE -l - {_S} END"
_QUICK = f"CASE WHEN d < 0 THEN CASE WHEN {_S} > 0 THEN {_LINEAR} ELSE 0 END + CASE WHEN {_S} >= {RATE} / 1.3::DOUBLE * -l THEN {RATE} * d ELSE {_CURVED} END WHEN d > 0 THEN CASE WHEN {_S} < 0 THEN {_LINEAR} ELSE 0 END + CASE WHEN {_S} <= {RATE} / 1.3::DOUBLE * -l THEN {RATE} * d ELSE {_CURVED} END ELSE {_LINEAR} END"


@query(chase_sql(f"{RATE}::DOUBLE * g"))
def optim_backprop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chase(spark, sf_dir, "B")


@query(chase_sql(_QUICK))
def optim_quickprop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chase(spark, sf_dir, "Q")


@query(chase_sql(f"{RATE}::DOUBLE * CASE WHEN abs(g) < 1e-17 THEN 0 ELSE sign(g) END"))
def optim_manhattan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chase(spark, sf_dir, "M")


@query(chase_sql("CASE WHEN c < 0 THEN -d ELSE sg * z2 END", "CASE WHEN c > 0 THEN least(1.2::DOUBLE * z, 50) WHEN c < 0 THEN greatest(0.5::DOUBLE * z, 1e-6) ELSE z END", "CASE WHEN c < 0 THEN 0 ELSE g END"))
def optim_rprop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chase(spark, sf_dir, "R")


# Neural network: two inputs, two hidden units, one output.

SHAPE = mlp.Shape(2, 2)
START = [0.1, -0.2, 0.3, -0.1, 0.2, 0.4, 0.05, -0.3, 0.25]


def net_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_totalprice") / 500000, (F.col("o_custkey") % 10 / 10).cast("double")).alias("features"), (F.col("o_orderstatus") == "F").cast("double").alias("label"), (F.col("o_orderkey") % 3 != 0).alias("training"))
    return with_worker_id(x, W, "o_orderkey")


def mlp_chain(steps: int) -> str:
    """Weights w0 to w8, quick propagation; g{t} are the gradients of iteration t."""
    p = range(9)
    h = [f"1 / (1 + exp(-(w{a} + w{a + 1} * x1 + w{a + 2} * x2)))" for a in (0, 3)]
    sql = f"WITH d AS (SELECT o_orderkey % {W} AS k, o_totalprice / 500000 AS x1, (o_custkey % 10) / 10 AS x2, (o_orderstatus = 'F')::INT::DOUBLE AS y, o_orderkey % 3 <> 0 AS tr FROM orders), c AS (SELECT count(*) FILTER (WHERE tr) AS n FROM d), m1 AS (SELECT "
    sql += ", ".join(f"{w}::DOUBLE AS w{i}, 0.0::DOUBLE AS d{i}, 0.0::DOUBLE AS l{i}" for i, w in enumerate(START)) + ")"
    for t in range(2, steps + 1):
        b = f"m{t - 1}"
        sql += f", h{t} AS (SELECT d.*, {b}.*, {h[0]} AS h0, {h[1]} AS h1 FROM d, {b}), o{t} AS (SELECT *, 1 / (1 + exp(-(w6 + w7 * h0 + w8 * h1))) AS o FROM h{t})"
        sql += f", e{t} AS (SELECT *, (y - o) * (o * (1 - o) + 0.1) AS dd FROM o{t}), q{t} AS (SELECT *, dd * w7 * (h0 * (1 - h0) + 0.1) AS q0, dd * w8 * (h1 * (1 - h1) + 0.1) AS q1 FROM e{t})"
        g = ["q0", "q0 * x1", "q0 * x2", "q1", "q1 * x1", "q1 * x2", "dd", "dd * h0", "dd * h1"]
        sql += f", g{t} AS (SELECT " + ", ".join(f"sum({x}) FILTER (WHERE tr) AS g{i}" for i, x in enumerate(g)) + f" FROM q{t})"
        sql += f", r{t} AS (SELECT avg(a) AS train_error, avg(b) AS test_error FROM (SELECT k, avg((y - o) * (y - o)) FILTER (WHERE tr) AS a, coalesce(avg((y - o) * (y - o)) FILTER (WHERE NOT tr), 0) AS b FROM q{t} GROUP BY k))"
        step = lambda i: _QUICK.replace("-0.35::DOUBLE", "-0.35::DOUBLE / n").replace(_S, f"(1e-4::DOUBLE * w{i} - g{i})").replace("-l", f"-l{i}").replace(" d ", f" d{i} ").replace("* d ", f"* d{i} ").replace("ELSE d ", f"ELSE d{i} ")
        sql += f", z{t} AS (SELECT *, " + ", ".join(f"{step(i)} AS s{i}" for i in p) + f" FROM {b}, g{t}, c), m{t} AS (SELECT " + ", ".join(f"w{i} + s{i} AS w{i}, s{i} AS d{i}, g{i} AS l{i}" for i in p) + f" FROM z{t})"
    return sql


def _unpivot(names: str, source: str, alias: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {names}{i}" for i in range(9))
    return f" SELECT i::INTEGER AS idx, round(CASE i {cases} END, 6) + 0.0 AS {alias} FROM {source}, range(9) AS r(i)"


@query(mlp_chain(2) + " SELECT k::INTEGER AS worker_id, round(avg(o), 6) + 0.0 AS mean_output, round(avg(h0), 6) + 0.0 AS mean_hidden FROM o2 GROUP BY k")
def mlp_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mlp.forward(net_rows(spark, sf_dir), START, SHAPE).groupBy(WORKER).agg(F.avg("o0").alias("mean_output"), F.avg("h0").alias("mean_hidden"))
    return rounded(x, "mean_output", "mean_hidden")


def _gradients(spark: SparkSession, sf_dir: str, wide: bool) -> DataFrame:
    g = mlp.mlp_job(net_rows(spark, sf_dir), SHAPE, initial=START, max_iter=2, wide=wide).run().state["gradients"]
    return rounded(spark.createDataFrame(list(enumerate(g)), "idx int, gradient double"), "gradient")


@query(mlp_chain(2) + _unpivot("g", "g2", "gradient"))
def mlp_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gradients(spark, sf_dir, False)


@query(mlp_chain(2) + _unpivot("g", "g2", "gradient"))
def mlp_gradient_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gradients(spark, sf_dir, True)


@query(mlp_chain(4) + _unpivot("w", "m4", "weight"))
def mlp_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, mlp.mlp_job(net_rows(spark, sf_dir), SHAPE, rate=RATE, initial=START, max_iter=4).run().state["weights"])


@query(mlp_chain(3) + " SELECT 2::INTEGER AS iteration, round(train_error, 6) + 0.0 AS train_error, round(test_error, 6) + 0.0 AS test_error FROM r2 UNION ALL SELECT 3::INTEGER, round(train_error, 6) + 0.0, round(test_error, 6) + 0.0 FROM r3")
def mlp_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = mlp.mlp_job(net_rows(spark, sf_dir), SHAPE, rate=RATE, initial=START, max_iter=3).run()
    return rounded(r.trace().where("iteration > 1").select("iteration", "train_error", "test_error"), "train_error", "test_error")


# Lifecycle and custom workers.


@query("SELECT bool_and(halt) AS halt FROM (SELECT l_orderkey % 4, sum(l_quantity) > 0 AS halt FROM lineitem GROUP BY 1)")
def halt_all_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custom.all_halt(quantities(spark, sf_dir).groupBy(WORKER).agg((F.sum("value") > 0).alias("halt")))


@query(sum_chain(1) + " SELECT count(*) AS n_results, sum(s)::BIGINT AS s FROM s")
def combine_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custom.merge_partials(worker_sums(quantities(spark, sf_dir)), ["s"], 2)


@query("SELECT worker_id, count(*) AS n_keys, sum(c_custkey)::BIGINT AS last_keys FROM (SELECT (c_custkey % 4)::INTEGER AS worker_id, c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey % 4, c_nationkey ORDER BY c_custkey DESC) = 1) GROUP BY 1")
def keyed_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_worker_id(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), W, "c_custkey")
    return custom.keyed_fold(rows, ["c_nationkey"], "c_custkey", [F.count("*").alias("n_keys"), F.sum("c_custkey").alias("last_keys")])


@query("SELECT extension, count(*) AS n FROM (SELECT 'training' AS extension FROM orders UNION ALL SELECT 'validation' FROM customer) GROUP BY 1")
def tagged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tag_source(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "training")
    return a.unionByName(tag_source(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "validation")).groupBy("extension").agg(F.count("*").alias("n"))


@query("SELECT user_id AS iteration, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
def repeated_results_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select(F.col("user_id").alias("iteration"), F.col("event_type").alias("worker_id"), "ts")
    return accepted(x).groupBy("iteration").agg(F.count("*").alias("n"))


@query("SELECT user_id % 5 AS iteration, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n_results, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def result_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("iteration"), "ts", "value")
    return windowed_sums(x, window="1 hour").withColumn("value", F.round("value", 4))


_ORDER = [("a", "before_application", 0), ("b", "before_application", 0), *[x for t in (1, 2) for x in (("a", "before_iteration", t), ("b", "before_iteration", t), ("b", "after_iteration", t), ("a", "after_iteration", t))], ("callback", "completion", 2), ("b", "after_application", 2), ("a", "after_application", 2)]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::INTEGER, '{a}', '{b}', {t}::INTEGER)" for i, (a, b, t) in enumerate(_ORDER)) + ") AS v(position, label, event, iteration)")
def hook_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    log: list[tuple[str, str, int]] = []
    setup = lambda c: c.on_completion(lambda d: log.append(("callback", "completion", d.iteration)))
    carry_sum_job(quantities(spark, sf_dir), 2, None, system_hooks=(LogHook("a", log),), hooks=(LogHook("b", log),), setup=setup).run()
    return spark.createDataFrame([(i, *x) for i, x in enumerate(log)], "position int, label string, event string, iteration int")
