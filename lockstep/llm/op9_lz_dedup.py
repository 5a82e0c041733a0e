"""Substring dedup by relative Lempel-Ziv parsing (words)."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .factors import repeats
from .textkit import chunks, words
from .windows import repeated_spans

LEAST, ANCHOR = 13, 6


def _drop_words(texts: pa.Table, raw: list[bytes], row: np.ndarray, start: np.ndarray, end: np.ndarray, emit: str) -> dict[str, pa.Array]:
    n = len(raw)
    removed = np.bincount(row, end - start, n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
    factors = np.bincount(row, minlength=n).astype(np.int64)
    first = np.searchsorted(row, np.arange(n + 1))
    counts, kept = [], []
    for i, j in chunks(raw):
        buffer, begin, stop, at = words(raw[i:j])
        data = buffer.tobytes()
        for t in range(i, j):
            a, z = at[t - i], at[t - i + 1]
            counts.append(z - a)
            stay = np.ones(z - a, bool)
            for x, y in zip(start[first[t] : first[t + 1]], end[first[t] : first[t + 1]], strict=True):
                stay[x:y] = False
            text = b" ".join([data[x:y] for x, y in zip(begin[a:z][stay].tolist(), stop[a:z][stay].tolist(), strict=True)])
            kept.append(hashlib.sha256(text).hexdigest() if emit == "digest" else text.decode())
    out = {"n_words": pa.array(np.array(counts, np.int64)), "n_removed": pa.array(removed), "n_factors": pa.array(factors)}
    return out | {"kept_sha256" if emit == "digest" else "kept_text": pa.array(kept, pa.string())}


def lz_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = LEAST, anchor: int = ANCHOR, emit: str = "text", keep: bool = True, **sizes: int) -> DataFrame:
    """Removes the words of factors that copy `least` or more consecutive words from a document with a smaller id.

    A reference block holds the passages of a range of anchors (see `windows`), and each passage of a document is parsed against the block that holds its anchor: greedily, the longest factor that
    a smaller document of the block has, then on from the first string of `least` words across its end (see `factors`). A factor of `least` words
    has an anchor, so no other block can hold it. Passages that a smaller document holds as a whole are one factor without a parse, and those whose anchor no
    other document has are literals. Strings are judged on the input, not on what is left.
    n_factors counts the factors after those that touch have been joined.

    emit="text": the rows of `docs` with n_words, n_removed, n_factors and kept_text (kept words joined by one space);
    emit="digest": kept_sha256 instead. Words are runs of bytes other than space and \\t to \\r, unchanged.
    Nulls, ties, repeated rows and clashing names: see `windows.repeated_spans`. Texts of under `least` words stay.
    """
    tail = "kept_sha256 string" if emit == "digest" else "kept_text string"
    return repeated_spans(docs, id_col, text_col, unit="word", window=least, k=min(anchor, least - 1), find=repeats, finish=partial(_drop_words, emit=emit), adds=f"n_words bigint, n_removed bigint, n_factors bigint, {tail}", keep=keep, **sizes)


def op9_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), emit="digest", keep=False)
