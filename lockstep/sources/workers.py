"""Logical workers: a column worker_id, whatever the physical partitions are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORKER = "worker_id"


def with_worker_id(df: DataFrame, n: int | None = None, key: str | list[str] | Column | None = None, *, file: str | None = None, folders: bool = False) -> DataFrame:
    """Adds worker_id (0 to n - 1).

    key a long column or expression: its remainder. key a list of columns: a hash of them. file: a column of file names, each of which
    is a worker, numbered by name; with `folders` the files of a folder are one worker's. The names are read at once, and a row for each comes to the driver, as it
    does when Spark plans a scan; they go out to the rows, so that a large file's rows stay in as many tasks as read them. A null key or file is worker 0's.
    """
    if file is not None:
        names = [r[0] for r in df.select(file).distinct().collect()]
        group = {n: n.rpartition("/")[0] if folders and n is not None else n for n in names}
        number = {g: i for i, g in enumerate(sorted({*group.values()}, key=lambda g: (g is not None, (g or "").encode())))}
        numbers = df.sparkSession.createDataFrame([(n, number[g]) for n, g in group.items()], f"__file string, {WORKER} int")
        return df.join(F.broadcast(numbers), F.col(file).eqNullSafe(F.col("__file"))).drop("__file")
    if not n or n < 1 or key is None:
        raise ValueError("give a number of workers and a key, or a column of file names")
    value = F.xxhash64(*key) if isinstance(key, list) else F.col(key) if isinstance(key, str) else key
    return df.withColumn(WORKER, F.coalesce(F.pmod(value.cast("long"), F.lit(n)).cast("int"), F.lit(0)))


def tag_source(df: DataFrame, extension: str, column: str = "extension") -> DataFrame:
    """Marks all rows of one source, so that a union of several can tell them apart."""
    return df.withColumn(column, F.lit(extension))


def require_workers(df: DataFrame, n: int) -> DataFrame:
    """The same rows; raises if a worker has none."""
    there = {r[WORKER] for r in df.select(WORKER).distinct().collect()}
    if missing := sorted({*range(n)} - there):
        raise ValueError(f"no data for workers {missing[:20]}")
    return df


def only_workers(df: DataFrame, workers: list[int]) -> DataFrame:
    """Rows of some workers: what is left when the others are late."""
    return df.where(F.col(WORKER).isin(workers))
