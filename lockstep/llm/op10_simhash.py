"""SimHash near-dedup by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import SHARES, forget, met_by, saved, without
from .textkit import chunks, lean, utf8

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Groups of up to so many fingerprints are compared pair by pair; larger ones are divided by more masks.
PAIRWISE = 64
#: Parts of a hot key's rows.
SALTS = 64


def shingle_hashes(text: bytes, n: int) -> list[int]:
    """XXH64 of each n-word shingle of the lower-cased text; of the whole sequence if it has fewer words."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[: len(end) - n] + 1]).tolist()
    h = xxhash.xxh64_intdigest
    return [h(joined[a:z], SEED) for a, z in zip(start, end[n - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[bytes], n: int) -> np.ndarray:
    """64 bits a text; a bit is 1 if it is set in over half of the shingles' hashes."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, j in chunks(texts):
        hashes = [shingle_hashes(t, n) for t in texts[i:j]]
        for k, h in enumerate(hashes, i):
            if h:
                ones = np.zeros(64, np.int64)
                for a in range(0, len(h), 1 << 16):
                    ones += np.unpackbits(np.array(h[a : a + (1 << 16)], np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                out[k] = weights[2 * ones > len(h)].sum(dtype=np.uint64)
    return out


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp as a signed long of the same bits."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(utf8(b.column(1)), shingle).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(mapped, "id bigint, fp bigint")


def _half(fp: Column, side: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if side else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _each(masks: list[int]) -> Column:
    """One row for each mask: pos, col."""
    return F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks]))


def _bit(value: Column, bits: Column) -> Column:
    """1 if any of `bits` is set in the value."""
    return (value.bitwiseAND(bits) != 0).cast("int")


FULL = 0xFFFFFFFF
ONE = [FULL & ~(1 << i) for i in range(32)]
PAIRS = [(i, j) for i in range(32) for j in range(i)]
TWO = [ONE[i] & ONE[j] for i, j in PAIRS]


def links(distinct: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """(u, v): enough pairs of distinct fingerprints at distance 1 or 2 to connect all those that are.

    Of two such fingerprints one 32-bit segment differs in at most one bit. The Hamming ball of radius one around each segment is enumerated as 32 values
    with one bit cleared, which two segments share exactly if they are within one flipped bit; equal values are the table matches, and
    full distances are verified. A match group above `pairwise` isn't compared pair by pair: clearing one more bit in the other segment (or two, where the
    first is equal) leaves at most four fingerprints, all within two bits of each other. Which of the four stand there is a number of four bits, so such a
    group is summed up before it is sent, however large.
    """
    fp = F.col("fp")
    pos, mask = F.col("pos").cast("long"), F.col("col")
    side, bit = F.shiftright(pos, 5), pos.bitwiseAND(F.lit(31))
    value = F.when(side == 0, _half(fp, 0)).otherwise(_half(fp, 1)).bitwiseAND(mask)
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # each row becomes 64
    keys = spread.select("fp", _each(ONE + ONE)).select("fp", value.bitwiseOR(F.shiftleft(side, 38)).bitwiseOR(F.shiftleft(bit, 32)).alias("key"))
    # Keys meet once, with the least and the greatest of their fingerprints: a group of two is a pair already, and only larger ones are asked for their members.
    met = saved(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"), "matches")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS
    two = met.where("n = 2").where(near).select("u", "v")
    larger = met.where("n > 2").select("key", "n")
    # Of the rows of a hot key (at most `SHARES` of them) each takes one of some salts. The join is a shuffle at every size, so that its cost grows in proportion.
    hot = F.broadcast(larger.where(F.col("n") * SHARES >= F.lit(64 * distinct.count())).select("key", F.lit(SALTS).alias("salts")))
    salted = keys.join(hot, "key", "left").select("key", "fp", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("salts")), F.lit(0)).alias("salt"))
    asked = larger.join(hot, "key", "left").select("key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - F.lit(1).cast("long"))).alias("salt"))
    hits = saved(salted.join(asked.hint("merge"), ["key", "salt"]).select("key", "fp", "n"), "hits")
    groups = hits.where(F.col("n") <= pairwise).groupBy("key").agg(F.collect_list("fp").alias("all"))
    few = groups.select("all", F.explode("all").alias("u")).select("u", F.explode(F.filter("all", lambda v: (v > F.col("u")) & (F.bit_count(v.bitwiseXOR(F.col("u"))) <= RADIUS))).alias("v"))
    many = hits.where(F.col("n") > pairwise).select("fp", F.shiftright("key", 38).alias("side"), F.shiftright("key", 32).bitwiseAND(F.lit(31)).alias("i"))
    own, other = F.when(F.col("side") == 0, _half(fp, 0)).otherwise(_half(fp, 1)), F.when(F.col("side") == 0, _half(fp, 1)).otherwise(_half(fp, 0))
    own_at, other_at = F.when(F.col("side") == 0, F.lit(0)).otherwise(F.lit(32)), F.when(F.col("side") == 0, F.lit(32)).otherwise(F.lit(0))
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))

    def flags(x: DataFrame, first: Column, second: Column) -> DataFrame:
        """base: the fingerprint with both bits cleared; seen: a bit for each of the four fingerprints that stand there."""
        place = x.select("fp", first.alias("a"), second.alias("b"))
        which = _bit(fp, F.col("a")) + 2 * _bit(fp, F.col("b"))
        here = F.when(which == 0, F.lit(1)).when(which == 1, F.lit(2)).when(which == 2, F.lit(4)).otherwise(F.lit(8))
        return place.select(fp.bitwiseAND(F.bitwise_not(F.col("a").bitwiseOR(F.col("b")))).alias("base"), "a", "b", here.alias("seen"))

    crossed = flags(many.select("fp", "side", "i", _each(ONE)), one(F.col("i") + own_at), one(F.col("pos") + other_at))
    # An equal segment is in all its 32 groups, so the one with bit 0 cleared stands for them.
    within = many.where("i = 0").select("fp", "side", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in PAIRS])).alias("p"))
    within = flags(within, one(F.col("p.i") + other_at), one(F.col("p.j") + other_at))
    stars = crossed.union(within).groupBy("base", "a", "b").agg(F.bit_or("seen").alias("seen")).where(F.bit_count("seen") > 1)
    base, a, b = F.col("base"), F.col("a"), F.col("b")
    four = [base, base.bitwiseOR(a), base.bitwiseOR(b), base.bitwiseOR(a).bitwiseOR(b)]
    present = F.array_compact(F.array(*[F.when(F.col("seen").bitwiseAND(F.lit(1 << k)) != 0, x) for k, x in enumerate(four)]))
    stars = stars.select(present.alias("all")).select(F.get("all", F.lit(0)).alias("u"), F.explode("all").alias("v")).where("u != v")
    out = saved(two.union(few).union(stars).distinct(), "links")
    forget(hits)
    forget(met)
    return out


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, pairwise: int = PAIRWISE) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row: fingerprints link at `RADIUS` or fewer differing bits.

    component_id is the smallest id reachable over links, the row's own included. A null text has no words, as an empty one; texts without words have
    fingerprint zero and link like any other. Rows with a null id get a fingerprint and their component's id, which only
    non-null ids give (null if there is none). Repeated rows give repeated results; an empty table an empty one. Other columns of `docs` are not returned.
    """
    own = saved(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = saved(own.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "distinct")
    pairs = links(distinct.select("fp"), pairwise)
    roots = components(pairs)
    forget(pairs)
    linked = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    firsts = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    named = saved(met_by(linked, firsts, "root", "m").select("fp", "n", "component_id"), "named")
    forget(distinct)
    return met_by(own, named, "fp", "n").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of `docs` that are first of their component; rows with a null id stay."""
    lost = simhash_groups(docs, id_col, text_col, **how).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__s_id")).distinct()
    return docs.join(lost, docs[f"`{id_col}`"] == lost["__s_id"], "left_anti")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(without(spark.read.parquet(f"{sf_dir}/documents.parquet"), "fingerprint"))
