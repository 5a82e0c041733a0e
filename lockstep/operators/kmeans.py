"""k-means with cosine similarity, over (worker_id, features array<double> with nulls, and an order key)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scalars import less, ratio
from ..functions.vectors import filled, norm
from ..plans.job import Context, IterativeJob, State
from ..sources.workers import WORKER
from .partials import ROWS

SCHEMA = "halt boolean, k int, c int, points array<array<double>>"
#: Rows, about, that one task ranks together when seeds are taken, as long as there are at most `BLOCKS` such shares; sampled keys for each share.
RANKED, BLOCKS, SAMPLED = 100_000, 4096, 64
#: Up to so many centres times coordinates a score is a column expression; beyond, NumPy makes it from Arrow batches.
WIDE = 256
MODES = ("compat", "cosine", "euclidean")


def cuts(df: DataFrame, key: str, parts: int, n: int) -> list[list]:
    """Keys, in groups of about the square root of their number, that cut the rows into about `parts` equal shares; from a sample, as where they lie matters to the cost alone."""
    order = df.select(key).where(F.col(key).isNotNull()).sample(min(1.0, SAMPLED * parts / n), 7).orderBy(key).collect()
    found = [order[i * len(order) // parts][0] for i in range(1, parts)] if order else []
    found = [x for i, x in enumerate(found) if not i or x != found[i - 1]]
    side = max(1, math.isqrt(len(found)))
    return [found[i : i + side] for i in range(0, len(found), side)]


def block_of(key: Column, groups: list[list]) -> Column:
    """How many of the cuts are at most the key: first among the groups' beginnings, then within one group."""
    if not groups:
        return F.lit(0)
    firsts = F.array(*[F.lit(g[0]) for g in groups])
    g = F.coalesce(F.size(F.filter(firsts, lambda c: c <= key)), F.lit(0))
    rest = F.array(*[F.array(*[F.lit(x) for x in group]) for group in groups])
    side = len(groups[0])
    inside = F.size(F.filter(F.get(rest, g - 1), lambda c: c <= key))
    return F.when(g == 0, F.lit(0)).otherwise((g - 1) * side + inside)


def ranks(df: DataFrame, key: str, block: int = RANKED) -> DataFrame:
    """df with __rank, 0-based by `key` (of any type that can be ordered) within each worker, and __n, the worker's rows.

    Sampled keys cut the rows into blocks; which block a row falls in is exact, and so are the counts of blocks before it, so only a block
    is ranked in one task however many rows a worker has. Equal keys rank by their features, and null keys first.
    """
    n = df.count()
    parts = min(BLOCKS, n // block + 1)
    rows = df.withColumn("__block", block_of(F.col(key), cuts(df, key, parts, n) if parts > 1 else []))
    blocks = rows.groupBy(WORKER, "__block").agg(F.count("*").alias("__m"))
    own = Window.partitionBy(WORKER)
    before = F.sum("__m").over(own.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(WORKER, "__block", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__m").over(own).alias("__n"))
    within = F.row_number().over(Window.partitionBy(WORKER, "__block").orderBy(key, "features")) - 1
    return rows.withColumn("__in", within).join(blocks, [WORKER, "__block"]).withColumn("__rank", F.col("__in") + F.col("__before")).drop("__block", "__in", "__before")


def seeds(df: DataFrame, k: int, key: str) -> DataFrame:
    """(worker_id, rank, point): all rows of a worker with at most k, else every m-th by the key, where m is a k-th of the worker's rows: fewer than 2 k a worker."""
    m = F.greatest(F.floor(F.col("__n") / k), F.lit(1))
    return ranks(df, key).where((F.col("__n") <= k) | (F.col("__rank") % m == 0)).select(WORKER, F.col("__rank").alias("rank"), filled(F.col("features")).alias("point"))


def first_centres(points: Sequence[Sequence[float]], k: int) -> list[list[float]]:
    """Of the seeds by length every so-manyth, k in all; those of equal length keep their order."""
    if len(points) < k:
        raise ValueError(f"{len(points)} seeds are fewer than k = {k}")
    by_length = sorted(points, key=lambda p: math.sqrt(sum(x * x for x in p)))
    return [list(by_length[i * (len(points) // k)]) for i in range(k)]


def _at(features: Column, j: int) -> Column:
    """A coordinate; 0 where the row has fewer."""
    return F.coalesce(F.get(features, F.lit(j)), F.lit(0.0))


def similarity(features: Column, length: Column, centre: Sequence[float]) -> Column:
    """Cosine with a fixed centre; unrolled. NaN if either is zero or NaN."""
    product = sum((_at(features, j) * F.lit(float(x)) for j, x in enumerate(centre)), F.lit(0.0))
    return ratio(product, length * F.lit(math.sqrt(sum(x * x for x in centre))))


def nearest(x: np.ndarray, centres: np.ndarray, mode: str) -> np.ndarray:
    """The tag of each row of a matrix (see `assigned`)."""
    with np.errstate(all="ignore"):
        if mode == "euclidean":
            score = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2) if x.size * len(centres) <= DENSE else np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
            return np.where(np.isnan(score), np.inf, score).argmin(axis=1)
        length = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((centres * centres).sum(axis=1))[None]
        score = np.where(length == 0, np.nan, x @ centres.T / length)
    if mode == "cosine":
        return np.where(np.isnan(score), -np.inf, score).argmax(axis=1)
    below = score < score[:, :1]
    below[:, 0] = True  # centre 0 where none is below
    return len(centres) - 1 - below[:, ::-1].argmax(axis=1)


#: Numbers of an intermediate cube.
DENSE = 1 << 22


def coordinates(column: pa.ListArray, width: int) -> np.ndarray:
    """A matrix of the first `width` values of each list; nulls and missing values are 0."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    flat = np.where(np.isnan(flat) & column.flatten().is_null().to_numpy(zero_copy_only=False), 0.0, flat) if column.flatten().null_count else flat
    out = np.zeros((len(column), width))
    owner = np.repeat(np.arange(len(column)), size)
    nth = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    keep = nth < width
    out[owner[keep], nth[keep]] = flat[keep]
    return out


def _clean(column: pa.Array) -> pa.ListArray:
    """Without null lists, which count as empty, and starting at 0."""
    return pc.fill_null(column, []) if column.null_count else pa.concat_arrays([column])


def wide_sums(df: DataFrame, centres: Sequence[Sequence[float]], mode: str) -> DataFrame:
    """(tag, n, vector): as `cluster_sums`, by NumPy over Arrow batches. A task sends a row for each centre."""
    c = np.array(centres, float)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(c), np.int64), np.zeros(c.shape)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = coordinates(_clean(batch.column(0).slice(at, ROWS)), c.shape[1])
                tag = nearest(x, c, mode)
                n += np.bincount(tag, minlength=len(c))
                np.add.at(total, tag, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.float64()))], ["tag", "n", "vector"])

    parts = df.select(F.col("features").cast("array<double>")).mapInArrow(fold, "tag int, n bigint, vector array<double>")
    long = parts.select("tag", "n", F.posexplode("vector").alias("pos", "v")).groupBy("tag", "pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    whole = long.groupBy("tag").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("all"))
    return whole.select("tag", "n", F.transform("all", lambda x: x["v"]).alias("vector"))


def wide_assigned(df: DataFrame, centres: Sequence[Sequence[float]], mode: str) -> DataFrame:
    """As `assigned`, by NumPy over Arrow batches."""
    c, place = np.array(centres, float), df.columns.index("features")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = [nearest(coordinates(_clean(batch.column(place).slice(at, ROWS)), c.shape[1]), c, mode) for at in range(0, batch.num_rows, ROWS)]
            tag = np.concatenate(tags) if tags else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tag, pa.int32())], [*batch.schema.names, "tag"])

    cast = df.withColumn("features", F.col("features").cast("array<double>"))
    return cast.mapInArrow(mapped, StructType([*cast.schema.fields, StructField("tag", IntegerType())]))


def assigned(df: DataFrame, centres: Sequence[Sequence[float]], mode: str = "cosine", wide: bool | None = None) -> DataFrame:
    """df with tag, the centre of each row.

    compat: the last centre whose similarity is below that of centre 0, else 0 (so not the nearest; a NaN is below nothing). cosine: the most similar, euclidean: the
    nearest; the first of equals, a NaN never wins. `wide` chooses NumPy or column expressions (by default by the size of the plan they would make).
    """
    if mode not in MODES:
        raise ValueError(mode)
    if len(centres) * len(centres[0]) > WIDE if wide is None else wide:
        return wide_assigned(df, centres, mode)
    x = df.withColumn("__x", filled(F.col("features")))
    if mode == "euclidean":
        score = [sum(((_at(F.col("__x"), j) - F.lit(float(v))) * (_at(F.col("__x"), j) - F.lit(float(v))) for j, v in enumerate(c)), F.lit(0.0)) for c in centres]
    else:
        x = x.withColumn("__length", norm(F.col("__x")))
        score = [similarity(F.col("__x"), F.col("__length"), c) for c in centres]
    x = x.withColumns({f"__s{i}": s for i, s in enumerate(score)})
    s = [F.col(f"__s{i}") for i in range(len(centres))]
    if mode == "compat":
        tag = F.lit(0)
        for i in range(1, len(s)):
            tag = F.when(less(s[i], s[0]), F.lit(i)).otherwise(tag)
    else:
        worst = F.lit(float("-inf") if mode == "cosine" else float("inf"))
        clean = [F.when(F.isnan(v), worst).otherwise(v) for v in s]
        best = (F.greatest if mode == "cosine" else F.least)(*clean) if len(clean) > 1 else clean[0]
        tag = F.lit(0)
        for i in reversed(range(len(s))):
            tag = F.when(clean[i] == best, F.lit(i)).otherwise(tag)
    return x.withColumn("tag", tag.cast("int")).drop("__x", "__length", *(f"__s{i}" for i in range(len(s))))


def cluster_sums(df: DataFrame, centres: Sequence[Sequence[float]], mode: str, by_worker: bool = True) -> DataFrame:
    """([worker_id,] tag, n, c0, c1, ...): partial sums; nulls are 0."""
    sums = [F.sum(F.coalesce(F.get("features", F.lit(j)), F.lit(0.0))).alias(f"c{j}") for j in range(len(centres[0]))]
    return assigned(df, centres, mode, False).groupBy(*[WORKER] * by_worker, "tag").agg(F.count("*").alias("n"), *sums)


def kmeans_job(df: DataFrame, k: int, c: int, *, key: str, mode: str = "cosine", max_iter: int = 50, initial: Sequence[Sequence[float]] | None = None, wide: bool | None = None, **more: object) -> IterativeJob:
    """Always runs max_iter iterations: the first takes seeds (or `initial`), later ones assign and average. A centre without rows becomes NaN.

    In a result the centres are one step ahead of tags: those of the last iteration come from the centres before it (see `tagged`).
    """

    by_batch = k * c > WIDE if wide is None else wide

    def worker(data: DataFrame, state: State | None, context: Context) -> DataFrame | None:
        if state is None:
            return None if initial is not None else seeds(data, k, key)
        return wide_sums(data, state["points"], mode) if by_batch else cluster_sums(data, state["points"], mode, by_worker=False)

    def master(rows: list, state: State | None, context: Context) -> State:
        if state is None:
            points = [list(map(float, p)) for p in initial] if initial is not None else first_centres([r["point"] for r in sorted(rows, key=lambda r: (r[WORKER], r["rank"]))], k)
        else:
            by_tag = {r["tag"]: r for r in rows}
            sums = lambda i: by_tag[i]["vector"] if by_batch else [by_tag[i][f"c{j}"] for j in range(c)]
            points = [[v / by_tag[i]["n"] for v in sums(i)] if i in by_tag else [math.nan] * c for i in range(k)]
        return {"halt": False, "k": k, "c": c, "points": points}

    slim = lambda d: d.select(WORKER, F.col(key), F.slice("features", 1, c).alias("features"))
    return IterativeJob(df, worker, master, SCHEMA, max_iter=max_iter, prepare=slim, **more)


def centroid_frame(state: State, spark: object) -> DataFrame:
    """(k, coords)."""
    return spark.createDataFrame(list(enumerate(state["points"])), "k int, coords array<double>")


def tagged(df: DataFrame, states: dict[int, State], mode: str = "cosine") -> DataFrame:
    """df with the tags that the last iteration gave, from the centres before it; -1 after a single iteration."""
    before = max(states) - 1
    return assigned(df, states[before]["points"], mode) if before in states else df.withColumn("tag", F.lit(-1))
