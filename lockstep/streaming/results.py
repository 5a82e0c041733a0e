"""Workers' results as a stream: what is late or repeated is dropped, as a barrier would."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accepted(results: DataFrame, time: str = "ts", delay: str = "60 seconds", keys: tuple[str, ...] = ("iteration", "worker_id")) -> DataFrame:
    """The first result of each worker and iteration, if it isn't later than `delay` behind the newest seen. On a batch the delay has no effect."""
    return results.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys]) if results.isStreaming else results.dropDuplicates([*keys])


def windowed_sums(results: DataFrame, time: str = "ts", window: str = "60 seconds", delay: str = "60 seconds", value: str = "value") -> DataFrame:
    """(iteration, start, n_results, value): sums of what arrives for an iteration in each window; a window closes once the watermark has passed it."""
    rows = results.withWatermark(time, delay) if results.isStreaming else results
    out = rows.groupBy("iteration", F.window(time, window)).agg(F.count("*").alias("n_results"), F.sum(value).alias(value))
    return out.select("iteration", F.col("window.start").alias("start"), "n_results", value)
