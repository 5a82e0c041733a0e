"""Readers of text, sequence files and any format that Spark knows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that describe others; names that begin with _ or . are hidden by Spark itself.
META = ("pig_header", "pig_schema")
#: A file, or its folder, that a glob may name although it is hidden.
HIDDEN = r"/[_.][^/]*(/[^/]*)?$"


def not_meta() -> Column:
    """Whether a row's file is neither metadata, by its whole path, nor hidden, by its name or its folder's."""
    path = F.col("_metadata.file_path")
    return ~path.rlike("|".join(META)) & ~path.rlike(HIDDEN)


def paths(path: str | list[str]) -> list[str]:
    """A comma-separated list, or a list, of paths and globs. Commas within braces belong to the glob."""
    if not isinstance(path, str):
        return list(path)
    out, depth, held = [], 0, ""
    for c in path:
        depth += (c == "{") - (c == "}")
        if c == "," and depth <= 0:
            out.append(held)
            held = ""
        else:
            held += c
    return [p for p in map(str.strip, [*out, held]) if p]


def read(spark: SparkSession, path: str | list[str], fmt: str = "parquet", *, with_file: bool = False, **options: str) -> DataFrame:
    """Any format; files whose path tells that they are metadata are left out. `with_file` adds the column file. A path that matches nothing raises."""
    df = spark.read.format(fmt).options(**options).load(paths(path)).where(not_meta())
    return df.withColumn("file", F.col("_metadata.file_path")) if with_file else df


def read_text(spark: SparkSession, path: str | list[str], *, with_file: bool = False) -> DataFrame:
    """(value [, file]): lines of text files, which may be compressed (the suffix tells). A path that matches nothing raises."""
    df = spark.read.text(paths(path)).where(not_meta())
    return df.select("value", F.col("_metadata.file_path").alias("file")) if with_file else df.select("value")


def read_sequence(spark: SparkSession, path: str, kind: str = "text") -> DataFrame:
    """(key, value) of a sequence file. kind: "text" casts both to strings, "binary" to bytes, "native" keeps what their types are in Python.

    Spark has no DataFrame source for this format, so records pass through an RDD of key and value pairs, a partition for each split.
    """
    if kind not in ("text", "binary", "native"):
        raise ValueError(kind)
    pairs = spark.sparkContext.sequenceFile(",".join(paths(path)))
    if kind == "native":
        return pairs.toDF(["key", "value"])
    if kind == "text":
        return pairs.map(lambda r: tuple(None if x is None else x.decode("utf-8", "replace") if isinstance(x, bytes | bytearray) else str(x) for x in r)).toDF("key string, value string")
    return pairs.map(lambda r: tuple(None if x is None else bytearray(x) if isinstance(x, bytes | bytearray) else bytearray(str(x), "utf-8") for x in r)).toDF("key binary, value binary")


@contextmanager
def splitting(spark: SparkSession, split_bytes: int, combine: bool = True) -> Iterator[None]:
    """Within it, files are split at `split_bytes`; small ones share a split with `combine`, else each has its own. The plan must be run within it."""
    names = {"spark.sql.files.maxPartitionBytes": str(split_bytes), "spark.sql.files.openCostInBytes": "0" if combine else str(split_bytes), "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
