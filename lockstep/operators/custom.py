"""Workers in Python, keyed workers and merging of partial results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.workers import WORKER


def python_worker(df: DataFrame, partial: Callable[[pd.DataFrame], pd.DataFrame], merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One row for each worker, by Python.

    partial: a batch of one worker's rows to one row (without worker_id); merge: several such rows to one. Both must not care about order or grouping. A task keeps
    one row for each worker while it goes through its batches, and sends that; so a worker may have any number of rows.
    """
    names = [WORKER, *StructType.fromDDL(schema).fieldNames()]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, pd.DataFrame] = {}
        for batch in batches:
            for w, rows in batch.groupby(WORKER):
                part = partial(rows)
                held[w] = merge(pd.concat([held[w], part], ignore_index=True)) if w in held else part
        for w, part in held.items():
            yield part.assign(**{WORKER: w})[names]

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        return merge(rows.drop(columns=WORKER)).assign(**{WORKER: rows[WORKER].iloc[0]})[names]

    full = f"{WORKER} int, {schema}"
    return df.mapInPandas(fold, full).groupBy(WORKER).applyInPandas(close, full)


def last_by_key(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """Of each worker's rows with equal keys the one that comes last by `order`: a map that later rows overwrite. An aggregation, so hot keys combine before the shuffle."""
    keep = [WORKER, *keys]
    rest = [c for c in df.columns if c not in keep]
    by = F.struct(order if isinstance(order, Column) else F.col(order), *rest)
    return df.groupBy(*keep).agg(F.max_by(F.struct(*rest), by).alias("__v")).select(*keep, "__v.*")


def keyed_fold(df: DataFrame, keys: Sequence[str], order: str | Column, aggregates: Sequence[Column]) -> DataFrame:
    """Each worker's aggregates over the last row of each key; the aggregates may not care about the keys' order."""
    return last_by_key(df, keys, order).groupBy(WORKER).agg(*aggregates)


def merge_partials(results: DataFrame, sums: Sequence[str], groups: int = 10) -> DataFrame:
    """Adds up workers' results in groups before the last sum, and carries how many there were (n_results), so that a mean over workers stays what it is without merging."""
    bucket = F.pmod(F.col(WORKER), F.lit(groups))
    merged = results.groupBy(bucket.alias("__g")).agg(F.count("*").alias("n_results"), *(F.sum(c).alias(c) for c in sums))
    return merged.agg(F.sum("n_results").alias("n_results"), *(F.sum(c).alias(c) for c in sums))


def all_halt(results: DataFrame, halt: str = "halt") -> DataFrame:
    """(halt): whether all workers, of at least one, want to stop."""
    return results.agg(F.coalesce(F.min(F.col(halt)), F.lit(False)).alias("halt"))
