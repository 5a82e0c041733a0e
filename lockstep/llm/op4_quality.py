"""Quality rules: a ledger of failure bits and measurements, and versioned policies over it. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import without

GAP = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

#: Each rule's failure, from the measurements; its place is its bit. Rules are only ever added at the end.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 50,
    "repeats": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "duplicate_lines": lambda: 2 * F.col("n_dup_lines") > F.col("n_lines"),
    "short_words": lambda: F.col("word_chars") < 2 * F.col("n_words"),
    "long_words": lambda: F.col("word_chars") > 12 * F.col("n_words"),
}
#: The rules that a policy version enforces. A version never changes; a new one is added.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeats"),
    "2024-1": ("few_words", "repeats", "symbols", "duplicate_lines"),
    "2024-2": tuple(RULES),
}
CURRENT = "2024-2"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def mask(policy: str) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r in POLICIES[policy])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: a lambda's variable isn't expanded for each use."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more."""

    def covered(grams: Column) -> Column:
        def positions(ranked: Column) -> Column:
            n = F.size(ranked)
            twin = lambda x, i: ((i > 0) & (F.get(ranked, i - 1)["g"] == x["g"])) | ((i < n - 1) & (F.get(ranked, i + 1)["g"] == x["g"]))
            return F.sort_array(F.transform(F.filter(ranked, twin), lambda x: x["i"]))

        ranked = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        total = lambda at: F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(let(ranked, positions), total))

    grams = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return let(let(words, grams), covered)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, the measurements, fail_bits): every rule evaluated once for each whole text.

    One pass without a shuffle; each document's work stays in its row, so no group of rows can grow hot. A null text has no words, like an empty one; a null
    id stays null; repeated rows give repeated results, an empty table an empty one. Other columns aren't returned.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))

    def measured(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    lines = F.filter(F.split("__q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    words = F.filter(F.split("__q_text", GAP), lambda w: w != "")
    slim = docs.select(F.col(f"`{id_col}`").alias(id_col), text.alias("__q_text"))
    rows = slim.select(id_col, let(words, measured).alias("__q_w"), let(lines, counted).alias("__q_l"), F.regexp_count("__q_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"))
    rows = rows.select(id_col, "n_symbols", "__q_w.*", "__q_l.*").select(id_col, *MEASURES)
    bits = sum((F.when(fails(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, fails in enumerate(RULES.values())), F.lit(0).cast("long"))
    return rows.withColumn("fail_bits", bits)


def judged(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and the policy's verdict kept."""
    fails = lambda p: F.col("fail_bits").bitwiseAND(F.lit(mask(p)).cast("long")) != 0
    return rows.withColumn("base_failed", fails("base")).withColumn("kept", ~fails("base") & ~fails(policy))


def ablations(rows: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """(policy, rule, failed, failed_alone, kept, kept_without): what each rule of each policy does.

    From the counts of each distinct value of fail_bits (at most two to the number of rules); no text is read again.
    failed: documents that fail the rule; failed_alone: those that fail no other rule of the policy, which its removal would keep.
    """
    counts = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(p)).cast("long").alias("mask"), F.lit(1 << i).cast("long").alias("bit")) for p in policies for i, r in enumerate(RULES) if r in POLICIES[p]]
    x = counts.select("fail_bits", "n", F.explode(F.array(*cases)).alias("c")).select("fail_bits", "n", "c.*")
    both = F.col("fail_bits").bitwiseAND(F.col("mask"))
    count = lambda when, name: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias(name)
    hit = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0
    return x.groupBy("policy", "rule").agg(count(hit, "failed"), count(both == F.col("bit"), "failed_alone"), count(both == 0, "kept"), count((both == 0) | (both == F.col("bit")), "kept_without"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = without(spark.read.parquet(f"{sf_dir}/documents.parquet"), *MEASURES)
    return judged(ledger(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


OP4_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM t, (SELECT unnest(range(0, 3)) AS d) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (2 * n_dup_lines > n_lines)::INT
  + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 12 * n_words)::INT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
