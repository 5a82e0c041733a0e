"""Tables written in the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset (one machine, tests) a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="lockstep-"))
    return f"file://{_LOCAL[0].name}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """The same rows, read again from a table of their own: a lost executor costs a read, not a recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lockstep_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Deletes the table of a `saved` frame that nothing reads any more."""
    path = getattr(df, "_lockstep_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops the columns that have one of these names in any case."""
    lower = {n.lower() for n in names}
    return df.select(*(df[f"`{c}`"] for c in df.columns if c.lower() not in lower))


#: A key is hot if it has one of so many equal shares of the rows, so there are at most as many hot keys.
SHARES = 1000


def met_by(rows: DataFrame, once: DataFrame, key: str, count: str) -> DataFrame:
    """rows.join(once, key), where `once` has each key once and in `count` how many of `rows` have it.

    Hot keys, at most `SHARES` of them, are broadcast, so their rows stay where they are; the others meet by a shuffle that no key outweighs.
    """
    total = once.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * SHARES >= F.lit(total)
    few = F.broadcast(once.where(hot))
    return rows.join(few, key).unionByName(rows.join(F.broadcast(once.where(hot).select(key)), key, "left_anti").join(once.where(~hot), key))
