"""Suffix-array dedup by depth-limited radix sort (bytes)."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .radix import repeats
from .windows import repeated_spans

THRESHOLD, ANCHOR = 50, 24


def _cut(texts: pa.Table, raw: list[bytes], row: np.ndarray, start: np.ndarray, end: np.ndarray, emit: str) -> dict[str, pa.Array]:
    n = len(raw)
    removed = np.bincount(row, end - start, n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
    spans = np.bincount(row, minlength=n).astype(np.int64)
    first = np.searchsorted(row, np.arange(n + 1))
    kept = []
    for i, t in enumerate(raw):
        if first[i] < first[i + 1]:
            a, z = start[first[i] : first[i + 1]], end[first[i] : first[i + 1]]
            t = b"".join(t[x:y] for x, y in zip([0, *z.tolist()], [*a.tolist(), len(t)], strict=True))
        kept.append(hashlib.sha256(t).hexdigest() if emit == "digest" else t.decode("utf-8", "ignore"))
    out = {"n_bytes": pa.array([len(t) for t in raw], pa.int64()), "n_removed": pa.array(removed), "n_spans": pa.array(spans)}
    if emit == "digest":
        return out | {"kept_sha256": pa.array(kept, pa.string())}
    owner = np.arange(n)
    pairs = [[{"start": int(x), "end": int(y)} for x, y in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)] for i in owner]
    return out | {"kept_text": pa.array(kept, pa.string()), "removed_spans": pa.array(pairs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: int = THRESHOLD, anchor: int = ANCHOR, emit: str = "text", keep: bool = True, **sizes: int) -> DataFrame:
    """Removes each byte covered by a `threshold`-byte string that also starts in a document with a smaller id.

    Suffixes are ordered by their bytes in most-significant-digit passes and only through `threshold` bytes (see `radix`); groups within one document drop out after
    each pass, and the groups left are exactly the repeated strings. Before that two passes over hashes of an anchor of `anchor` bytes and of its surroundings settle what repeats as a whole
    and leave out what can't repeat (see `windows`), as ordering every suffix would move many times the data.
    Strings are judged on the input, not on what is left.

    emit="text": the rows of `docs` with n_bytes, n_removed, n_spans, kept_text and removed_spans (byte offsets; a
    character that a span cuts through goes as a whole from kept_text). emit="digest": kept_sha256 of the exact remaining bytes instead.
    Nulls, ties, repeated rows and clashing names: see `windows.repeated_spans`. An empty text stays empty; an empty table gives an empty result.
    """
    tail = "kept_sha256 string" if emit == "digest" else "kept_text string, removed_spans array<struct<start:bigint,end:bigint>>"
    return repeated_spans(docs, id_col, text_col, unit="byte", window=threshold, k=min(anchor, threshold - 1), find=repeats, finish=partial(_cut, emit=emit), adds=f"n_bytes bigint, n_removed bigint, n_spans bigint, {tail}", keep=keep, **sizes)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), emit="digest", keep=False)
