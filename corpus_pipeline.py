"""A training-data pipeline: toxicity, near-dedup, substring dedup, decontamination, packing.

Each stage works on all that its predecessor kept, written as Parquet and read again; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm.op2_suffix_dedup import suffix_dedup
from lockstep.llm.op3_packing import packed
from lockstep.llm.op5_toxicity import drop_toxic
from lockstep.llm.op8_decontamination import decontaminate
from lockstep.llm.op10_simhash import simhash_dedup
from lockstep.llm.shared import forget, saved


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays."""
    return simhash_dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings go from all but the first document that has them; a character that is cut goes as a whole."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = suffix_dedup(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("others")) if others else docs)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")} | {c: F.col(f"others.c{i}") for i, c in enumerate(others)} | ({"n_chars": F.char_length("kept_text").cast("long")} if "n_chars" in others else {})
    return cut.select(*(made[c].alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences."""
    return packed(docs)


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("substrings", substrings), ("decontamination", decontamination), ("packing", packing)]
#: A trained classifier, a tokenizer and alignments: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
