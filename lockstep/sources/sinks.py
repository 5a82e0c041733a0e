"""Sinks of the shipped algorithms. Each writes a DataFrame, and errors raise."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_value(spark: SparkSession, value: int, path: str, mode: str = "error") -> None:
    """One line: the number."""
    spark.createDataFrame([(str(value),)], "value string").coalesce(1).write.mode(mode).text(path)


def model_frame(spark: SparkSession, weights: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "idx int, weight double")


def write_model(spark: SparkSession, weights: Sequence[float], path: str, fmt: str = "text", mode: str = "error") -> None:
    """text: one line [w0, w1, ...]; other formats: a row (idx, weight) for each weight."""
    if fmt == "text":
        spark.createDataFrame([("[" + ", ".join(repr(float(w)) for w in weights) + "]",)], "value string").coalesce(1).write.mode(mode).text(path)
    else:
        model_frame(spark, weights).coalesce(1).write.mode(mode).format(fmt).save(path)


def write_centroids(centroids: DataFrame, path: str, separator: str = ",", mode: str = "error") -> None:
    """One line a centre, in order, of a frame (k, coords)."""
    lines = centroids.orderBy("k").select(F.concat(F.lit("["), F.array_join(F.transform("coords", lambda x: x.cast("string")), separator + " "), F.lit("]")).alias("value"))
    lines.coalesce(1).write.mode(mode).text(path)


def write_tagged(tagged: DataFrame, path: str, features: str = "features", separator: str = "|", mode: str = "error") -> None:
    """One line a record: its fields and its tag; a null field prints as null. As many files as there are partitions."""
    fields = F.array_join(F.transform(F.col(features), lambda x: x.cast("string")), separator, "null")
    tagged.select(F.concat_ws(separator, fields, F.col("tag").cast("string")).alias("value")).write.mode(mode).text(path)


def write_network(spark: SparkSession, shape: dict[str, int], weights: Sequence[float], path: str, mode: str = "error") -> None:
    """The layers' sizes and the weights, as one JSON line."""
    spark.createDataFrame([(json.dumps(shape | {"weights": [float(w) for w in weights]}),)], "value string").coalesce(1).write.mode(mode).text(path)
