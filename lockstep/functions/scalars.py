"""Parsing and scalar functions over columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fields(line: Column, separator: str) -> Column:
    """Parts between literal separators; empty ones and those at the end stay."""
    return F.split(line, re.escape(separator), -1)


def parse_strict(text: Column, kind: str = "double") -> Column:
    """Raises on what isn't a number (in ANSI mode, which is Spark's default)."""
    return text.cast(kind)


def parse_or_null(text: Column, kind: str = "double") -> Column:
    return text.try_cast(kind)


def parse_or_default(text: Column, default: float, kind: str = "double", *, required: bool = False) -> Column:
    """The default for null or what isn't a number; with `required` such a value raises."""
    value = text.try_cast(kind)
    if not required:
        return F.coalesce(value, F.lit(default).cast(kind))
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit("not a number: "), F.coalesce(text, F.lit("null"))))).otherwise(value)


def numbers(parts: Column, n: int, on_bad: str = "null", missing: str = "zero", default: float = 0.0) -> Column:
    """The first n fields as an array of doubles; further ones are ignored.

    on_bad: "null", "default" or "raise". missing (too few fields): "zero" fills up with 0.0, "null" with null, "raise" raises.
    """
    parse = {"null": parse_or_null, "default": lambda x: parse_or_default(x, default), "raise": parse_strict}[on_bad]
    some = F.transform(F.slice(parts, 1, n), lambda x: parse(x))
    if missing == "raise":
        return F.when(F.size(parts) < n, F.raise_error(F.lit(f"fewer than {n} fields"))).otherwise(some)
    filler = F.lit(0.0) if missing == "zero" else F.lit(None).cast("double")
    return F.concat(some, F.array_repeat(filler, F.greatest(F.lit(n) - F.size(parts), F.lit(0))))


def sigmoid(z: Column) -> Column:
    """Saturates at 0 and 1."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def sign(value: Column, tolerance: float = 1e-13) -> Column:
    """-1, 0 or 1; 0 within the tolerance."""
    return F.when(F.abs(value) < tolerance, F.lit(0)).otherwise(F.signum(value).cast("int"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NaN where b is 0."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def less(a: Column, b: Column) -> Column:
    """a < b as floating-point numbers have it: false if either is NaN."""
    return (a < b) & ~F.isnan(a) & ~F.isnan(b)


def in_training(key: Column, share: float = 0.5, seed: int = 0) -> Column:
    """A repeatable random split: whether the first 32 bits of MD5 of "seed:key" lie in the share. A null key is tested, not trained on."""
    if not 0 <= share <= 1:
        raise ValueError("share must lie between 0 and 1")
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8)
    return F.coalesce(digest < F.lit(f"{int(share * (1 << 32)):08x}") if share < 1 else digest.isNotNull(), F.lit(False))


def with_training(df: DataFrame, training: Column) -> DataFrame:
    """df with a column training; where the condition is null a row is tested, not trained on."""
    return df.withColumn("training", F.coalesce(training, F.lit(False)))


def copies(n: int) -> Column:
    """To explode: 0 to n - 1."""
    return F.sequence(F.lit(0), F.lit(n - 1))
