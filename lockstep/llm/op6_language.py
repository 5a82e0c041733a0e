"""Language identification: the nearest of several TF-IDF centroids for each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op5_toxicity import held_out
from .op8_decontamination import normal_words
from .textkit import chunks, lean, pack, unpack, utf8

FOLDS, HELD_OUT = 5, 0
#: Labelled documents of each language that the centroids are fitted on (in expectation; chosen by a hash of the id), centroids of a language.
SAMPLE, CENTROIDS = 500, 3
BITS = 12
UNKNOWN = "und"
#: A text is rejected if its similarity lies so many standard deviations under its centroid's mean in the sample.
REJECT = 4.0
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_LETTER = regex.compile(r"\p{L}")


def letters(text: bytes) -> bool:
    return bool(_ASCII[np.frombuffer(text[:256], np.uint8)].any()) or bool(_LETTER.search(text.decode("utf-8", "replace")))


def counts(texts: list[bytes]) -> np.ndarray:
    """Counts of byte 2- and 3-grams within words (their edges count as a blank), hashed to 2**BITS, one row a text. Digits belong to words; other signs don't."""
    d = 1 << BITS
    out = np.zeros((len(texts), d), np.float32)
    for i, j in chunks(texts, 1 << 19):
        buffer, start, end, _ = normal_words(texts[i:j])
        inside = np.zeros(len(buffer) + 1, np.int8)
        inside[start] = 1
        inside[end] -= 1
        clean = np.where(np.cumsum(inside[:-1]) > 0, buffer, 32).astype(np.uint32)
        pair = clean[:-1] * np.uint32(256) + clean[1:]
        triple = pair[:-1] * np.uint32(256) + clean[2:]
        grams = [(pair * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), ((triple * np.uint32(0x85EBCA77)) ^ (triple >> np.uint32(7))) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - BITS)]
        solid = [pair != 0x2020, triple & np.uint32(0xFFFF00) != 0x202000]
        at = 0
        for k in range(i, j):
            z = at + len(texts[k])
            for n, (g, s) in enumerate(zip(grams, solid, strict=True)):
                x = slice(at, max(at, z - n))
                out[k] += np.bincount(g[x][s[x]], minlength=d)
            at = z + 1
    return out


@dataclass
class Centroids:
    idf: np.ndarray
    rows: np.ndarray
    lang: np.ndarray
    least: np.ndarray

    def vectors(self, count: np.ndarray) -> np.ndarray:
        v = np.log1p(count) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine, and whether the distance rule rejects it."""
        if not len(self.rows):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        close = self.vectors(counts(texts)) @ self.rows.T
        best = close.argmax(1)
        score = np.clip(close[np.arange(len(best)), best].astype(float), 0, 1)
        known = np.array([letters(t) for t in texts], bool)
        return [str(self.lang[b]) if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0), ~known | (score < self.least[best])


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and each row's cluster; begins with rows far from each other, so it depends on the rows alone."""
    chosen = [int((v @ v.mean(0)).argmax())]
    for _ in range(min(k, len(v)) - 1):
        chosen.append(int((v @ v[chosen].T).max(1).argmin()))
    c = v[chosen]
    own = np.zeros(len(v), int)
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        c = np.stack([v[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c, own


def fit(count: np.ndarray, lang: np.ndarray, n: int, held: np.ndarray, centroids: int = CENTROIDS) -> Centroids:
    """From the counts and languages of the sampled texts, the number of all training texts, and how many of those hold each n-gram."""
    idf = (np.log((1 + n) / (1 + held)) + 1).astype(np.float32)
    model = Centroids(idf, np.zeros((0, count.shape[1]), np.float32), np.zeros(0, str), np.zeros(0))
    rows, names, least = [], [], []
    v = model.vectors(count) if len(count) else count
    for name in sorted(set(lang.tolist())):
        some = v[lang == name]
        c, own = spherical_kmeans(some, centroids)
        for i, x in enumerate(c):
            near = some[own == i] @ x
            if len(near):
                rows.append(x)
                names.append(name)
                least.append(near.mean() - REJECT * max(near.std(), 0.01))
    return Centroids(idf, np.array(rows, np.float32).reshape(-1, count.shape[1]), np.array(names), np.array(least))


def _counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, out = utf8(b.column(1)), []
        for i, j in chunks(raw, 1 << 21):
            for row in counts(raw[i:j]):
                at = np.flatnonzero(row)
                out.append(pack(i_up=at.astype(np.uint16), n=row[at]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["lang", "blob"])


def _held_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts hold each n-gram; under -1 how many texts there are."""
    lean()
    n, held = 0, np.zeros(1 << BITS, np.int64)
    for b in batches:
        raw = utf8(b.column(0))
        n += len(raw)
        for at in range(0, len(raw), 512):
            for i, j in chunks(raw[at : at + 512], 1 << 21):
                held += (counts(raw[at + i : at + j]) > 0).sum(0)
    some = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(held[some], n), pa.int64())], ["gram", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Centroids:
    """Fits on documents with a language, an id and a letter that aren't held out.

    Document frequencies count all of them; the centroids come from about `sample` of each language. The number of languages is that of the data; each costs the driver `sample` vectors.
    """
    known = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = known.where(~held_out(F.col("id"), FOLDS, HELD_OUT) & F.col("text").rlike(r"\p{L}"))
    held, n = np.zeros(1 << BITS, np.int64), 0
    for r in known.select("text").mapInArrow(_held_by, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        if r["gram"] < 0:
            n = r["n"]
        else:
            held[r["gram"]] = r["n"]
    sizes = known.groupBy("lang").count().collect()
    rate = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1 << 30, (sample << 30) // r["count"])))]) if sizes else F.create_map(F.lit(""), F.lit(0))
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1 << 30)) < rate[F.col("lang")])
    rows = drawn.select("lang", "text").mapInArrow(_counts_of, "lang string, blob binary").orderBy("lang", F.xxhash64("blob")).collect()
    count = np.zeros((len(rows), 1 << BITS), np.float32)
    for k, r in enumerate(rows):
        x = unpack(bytes(r["blob"]))
        count[k, x["i_up"]] = x["n"]
    return fit(count, np.array([r["lang"] for r in rows]), n, held, centroids)


def identified(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score, rejected) of every row.

    score is the cosine to the nearest centroid; rejected tells that it lies too far off even so. A text that is null or has no letter is `und`, with score 0,
    and so is every text if no language was learned. A null id stays null; repeated rows repeat; among equal centroids the first language by name wins.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = utf8(b.column(2))
            lang, score, far = [], [], []
            a = 0
            while a < len(raw):
                z, held = a, 0
                while z < len(raw) and z - a < 512 and held < 1 << 21:
                    held += len(raw[z])
                    z += 1
                x = model.predict(raw[a:z])
                lang += x[0]
                score.append(x[1])
                far.append(x[2])
                a = z
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(np.concatenate([*score, np.zeros(0)])), pa.array(np.concatenate([*far, np.zeros(0, bool)]))], ["id", "held_out", "lang_pred", "score", "rejected"])

    key = F.col(f"`{id_col}`")
    rows = docs.select(key.cast("long").alias("id"), held_out(key, FOLDS, HELD_OUT).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(mapped, "id bigint, held_out boolean, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identified(docs, train(docs))
