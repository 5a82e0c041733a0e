"""Logical workers from stretches of files: each a block of one file, or several small ones together.

Spark reads files in splits of its own; which worker a row belongs to follows from the split's first byte, which every row carries.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import not_meta, paths, splitting
from .workers import WORKER

#: A file's last block may be this much larger before it is cut.
SLOP = 1.1
#: Suffixes of files that are read as a whole.
WHOLE = r"(?i)\.(gz|deflate|snappy|zst|lz4|parquet)$"
#: A gzip file of up to so many bytes is empty.
EMPTY_GZIP = 20


def splits(spark: SparkSession, path: str | list[str], block_bytes: int) -> DataFrame:
    """(file, index, start, length): blocks of `block_bytes`, the last of up to `SLOP` times that; a file that can't be cut is whole, and an empty one, which Spark doesn't read, has none.

    Only names and lengths of the files are read.
    """
    if block_bytes < 1:
        raise ValueError("block_bytes must be positive")
    files = spark.read.format("binaryFile").load(paths(path)).where(not_meta()).select(F.col("path").alias("file"), "length")
    share = F.col("length") / F.lit(block_bytes)
    n = F.when(F.col("file").rlike(WHOLE) | (share <= SLOP), F.lit(1)).otherwise(F.ceil(share - SLOP).cast("int") + 1)
    cut = files.withColumn("n", n).select("file", "length", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("index"))
    start = F.col("index").cast("long") * F.lit(block_bytes)
    end = F.when(F.col("index") == F.col("n") - 1, F.col("length")).otherwise(start + F.lit(block_bytes))
    return cut.select("file", "index", start.alias("start"), (end - start).alias("length"))


def packed(lengths: list[int], most: int) -> list[int]:
    """A bin for each length so that no bin of several exceeds `most`: the longest first, each into the fullest bin with room for it."""
    bins: list[int] = [0] * len(lengths)
    rooms: list[tuple[int, int]] = []  # room, bin; sorted
    used = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(rooms, (lengths[i], -1))
        room, b = rooms.pop(at) if at < len(rooms) else (max(most, lengths[i]), used)
        used += b == used
        bins[i] = b
        insort(rooms, (room - lengths[i], b))
    return bins


def worker_table(spark: SparkSession, path: str | list[str], block_bytes: int, combine_bytes: int | None = None) -> DataFrame:
    """(worker_id, file, index, start, length): a worker for each split, or with `combine_bytes` one for as many as fit into it.

    A worker that has nothing but empty gzip files is left out. A row for each split comes to the driver, as it does when Spark plans a scan.
    """
    rows = [tuple(r) for r in splits(spark, path, block_bytes).orderBy("file", "start").collect()]
    bins = packed([r[3] for r in rows], combine_bytes) if combine_bytes else list(range(len(rows)))
    empty = lambda r: r[0].endswith("gz") and r[2] == 0 and r[3] <= EMPTY_GZIP
    alive = {b for b, r in zip(bins, rows, strict=True) if not empty(r)}
    number = {b: i for i, b in enumerate(sorted(alive))}
    return spark.createDataFrame([(number[b], *r) for b, r in zip(bins, rows, strict=True) if b in number], f"{WORKER} int, file string, index int, start bigint, length bigint")


@contextmanager
def split_workers(spark: SparkSession, path: str | list[str], block_bytes: int, combine_bytes: int | None = None) -> Iterator[DataFrame]:
    """(worker_id, value): lines of text files with the worker whose split they are read in. The frame must be run, or kept, within the context.

    The table of splits goes out to the lines, so that those of one large file stay in the tasks that read them.
    """
    table = worker_table(spark, path, block_bytes, combine_bytes)
    with splitting(spark, block_bytes):
        at = F.col("_metadata.file_block_start")
        lines = spark.read.text(paths(path)).where(not_meta()).select("value", F.col("_metadata.file_path").alias("file"), F.floor(at / block_bytes).cast("int").alias("index"))
        last = table.groupBy("file").agg(F.max("index").alias("last"))
        placed = lines.join(F.broadcast(last), "file").withColumn("index", F.least("index", "last"))
        yield placed.join(F.broadcast(table.select(WORKER, "file", "index")), ["file", "index"]).select(WORKER, "value")
