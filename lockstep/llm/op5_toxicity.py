"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import chunks, lean, lift, pack, prefix_sums, slice_hashes, unpack, utf8
from .op8_decontamination import normal_words

FOLDS, HELD_OUT, LEAST_SCORE = 4, 2, 0.3
#: Most labelled rows of each class that the models are fitted on (in expectation; chosen by a hash of the id), voters, and features of the classifier.
SAMPLE, VOTERS, FEATURES = 2500, 160, 8192
#: A lexicon voter stands so many times as often in toxic texts as in others, and so many standard errors more often.
LIFT, SURPRISE = 40.0, 4.0
BITS = 20
PREFIXES = (4, 5, 6, 7)

LEXICON = """idiot moron stupid trash pathetic disgusting worthless clown scum loser dumb jerk imbecile garbage filth vermin creep freak hate ugly
idiote imbécile crétin débile ordure connard salaud abruti minable
idiotisch dumm blöd arschloch schwachkopf trottel widerlich abschaum versager müll
idiota imbécil estúpido basura asqueroso escoria payaso inútil perdedor""".split()


def _hash(words: list[str]) -> np.ndarray:
    buffer, start, end, first = normal_words([w.encode() for w in words])
    return slice_hashes(prefix_sums(lift(buffer)), start[first[:-1]], end[first[:-1]])


LEXICON_HASHES = np.sort(_hash(LEXICON))
#: Pattern voters: shouting (of 20 ASCII letters or more a third are capitals), exclamation (three marks in a row), lexicon (one word of it), lexicon twice.
PATTERNS = ("shouting", "exclamation", "lexicon", "lexicon_twice")


def features(texts: list[bytes], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature, count (sorted), and each text's pattern votes as bits.

    Features are whole words and word beginnings of 4 to 7 bytes, hashed to 2**BITS. With `chosen` (a bool for each feature) only those.
    """
    found = []
    votes = np.zeros(len(texts), np.int64)
    for i, j in chunks(texts, 1 << 19):
        buffer, start, end, first = normal_words(texts[i:j])
        sums = prefix_sums(lift(buffer))
        text = np.repeat(np.arange(i, j), np.diff(first))
        size = end - start
        whole = slice_hashes(sums, start, end)
        hit = np.zeros(len(whole), bool)
        at = np.searchsorted(LEXICON_HASHES, whole)
        hit[at < len(LEXICON_HASHES)] = LEXICON_HASHES[at[at < len(LEXICON_HASHES)]] == whole[at < len(LEXICON_HASHES)]
        hits = np.bincount(text[hit], minlength=j)[i:j]
        votes[i:j] |= 4 * (hits > 0) + 8 * (hits > 1)
        for x in (0, *PREFIXES):
            long = slice(None) if not x else size > x
            h = whole if not x else slice_hashes(sums, start[long], start[long] + x) + np.uint64(x)
            f = (h >> np.uint64(64 - BITS)).astype(np.int64)
            t = text[long]
            if chosen is not None:
                keep = chosen[f]
                f, t = f[keep], t[keep]
            found.append((t << BITS) | f)
        raw = np.frombuffer(b"\n".join(texts[i:j]) + b"\n", np.uint8)
        ends = np.cumsum([0] + [len(t) + 1 for t in texts[i:j]])
        capitals, letters = (np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in ((raw >= 65) & (raw <= 90), ((raw | 32) >= 97) & ((raw | 32) <= 122)))
        votes[i:j] |= (letters >= 20) & (3 * capitals >= letters)
    for k, t in enumerate(texts):
        if b"!!!" in t:
            votes[k] |= 2
    key, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return key >> BITS, key & ((1 << BITS) - 1), count, votes


@dataclass
class LabelModel:
    """Class prior, and for each voter its parent (-1: none) and the chances that it speaks, given the class and whether its parent does: speaks[class, parent speaks, voter]."""

    prior: float = 0.1
    parent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    speaks: np.ndarray = field(default_factory=lambda: np.zeros((2, 2, 0)))

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Of the class, by the voters that speak. One that is silent abstains: a lexicon of one language says nothing about a text in another."""
        given = np.where(self.parent >= 0, votes[:, self.parent], 0)
        chance = [np.where(given == 1, self.speaks[y, 1], self.speaks[y, 0]) for y in (0, 1)]
        return np.log(self.prior / (1 - self.prior)) + (votes * (np.log(chance[1]) - np.log(chance[0]))).sum(axis=1)


def _pairs(votes: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weight of the rows in which voters i and j say a and b, as [a, b, i, j]."""
    both = (votes * share[:, None]).T @ votes
    one = both.diagonal()
    return np.array([[share.sum() - one[:, None] - one[None, :] + both, one[None, :] - both], [one[:, None] - both, both]])


def dependencies(votes: np.ndarray, q: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each voter's parent in the tree that holds the strongest correlations given the class, by pairwise mutual information (Chow and Liu)."""
    m = votes.shape[1]
    shared = np.zeros((m, m))
    for share in (q * weight, (1 - q) * weight):
        n = _pairs(votes, share) + 0.25
        total = n.sum(axis=(0, 1))
        first, second = n.sum(axis=1, keepdims=True), n.sum(axis=0, keepdims=True)
        shared += (n * np.log(n * total / (first * second))).sum(axis=(0, 1))
    parent, best, near = np.full(m, -1), np.full(m, -np.inf), np.full(m, -1)
    inside = np.zeros(m, bool)
    for _ in range(m):  # Prim's algorithm
        new = int(np.where(inside, -np.inf, best).argmax()) if inside.any() else 0
        inside[new] = True
        parent[new] = near[new]
        closer = ~inside & (shared[new] > best)
        best[closer], near[closer] = shared[new][closer], new
    return parent


def fit_label_model(votes: np.ndarray, weight: np.ndarray, start: np.ndarray, prior: float, rounds: int = 20) -> tuple[LabelModel, np.ndarray]:
    """Expectation-maximisation over the votes alone, from a first guess of the class, with a given share of the class. Returns the model and the rows' posteriors.

    The rounds take voters as independent given the class; then a tree of correlations is estimated from their posteriors, and in one more round each voter's chances depend on its parent's
    vote too, so that voters that say the same count once.
    """
    votes, m = votes.astype(float), votes.shape[1]
    q, parent, model = start.astype(float), np.full(m, -1), LabelModel()
    for phase in (0, 1):
        if phase and m > 1:
            parent = dependencies(votes, q, weight)
        for _ in range(1 if phase else rounds):
            speaks = np.zeros((2, 2, m))
            given = np.where(parent >= 0, votes[:, parent], 0)
            mean = votes.mean(axis=0)
            for y, share in ((1, q * weight), (0, (1 - q) * weight)):
                for z in (0, 1):
                    here = share[:, None] * (given == z)
                    speaks[y, z] = (np.einsum("ij,ij->j", here, votes) + 0.5 * mean) / (here.sum(axis=0) + 0.5)
            model = LabelModel(prior, parent, np.clip(speaks, 1e-4, 1 - 1e-4))
            new = 1 / (1 + np.exp(-np.clip(model.log_odds(votes), -30, 30)))
            moved = np.abs(new - q).max() if len(q) else 0
            q = new
            if moved < 1e-4:
                break
    return model, q


def calibrate(z: np.ndarray, given: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Scale and shift of a log-odds score by which it fits the given labels best (logistic regression with one input, by Newton's method)."""
    x = np.column_stack([z, np.ones(len(z))])
    beta, goal = np.array([1.0, 0.0]), np.where(given == 1, 0.999, 0.001)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (weight * (p - goal)) + 1e-3 * (beta - [1.0, 0.0]))
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        beta = beta - step
        if np.abs(step).max() < 1e-6:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def fit_linear(row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, d: int, target: np.ndarray, weight: np.ndarray, rounds: int = 150, penalty: float = 3.0) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; adaptive gradient steps (Adam) on the whole sample."""
    w, b = np.zeros(d), float(np.log(max((target * weight).sum(), 1e-3) / max(((1 - target) * weight).sum(), 1e-3)))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    total = max(weight.sum(), 1e-9)
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[column] * value, n) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / total
        grad = np.append(np.bincount(column, g[row] * value, d) + penalty / total * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


@dataclass
class Toxicity:
    """The fitted classifier: a weight for each chosen feature."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float
    label_model: LabelModel

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self._score(texts[i:j]) for i, j in chunks(texts, 1 << 22))])

    def _score(self, texts: list[bytes]) -> np.ndarray:
        text, feature, count, _ = features(texts, self.chosen)
        z = np.bincount(text, self.weights[feature] * np.log1p(count), len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray, int]], weight: np.ndarray, voters: int = VOTERS, wanted: int = FEATURES) -> Toxicity:
    """From (label, features, counts, pattern votes) of the sampled rows.

    The given labels choose which words and word beginnings become lexicon voters, give the share of the class, and calibrate the scores in the end. What the classifier learns from are the label model's posteriors, which come from
    the votes alone.
    """
    n, size = len(rows), 1 << BITS
    given = np.array([r[0] for r in rows], np.int64)
    if not n or given.min() == given.max():
        rate = float(given.mean()) if n else 0.0
        bias = float(np.log((rate * n + 0.01) / ((1 - rate) * n + 0.99))) if n else -4.6
        return Toxicity(np.zeros(size, bool), np.zeros(size), bias, LabelModel())
    # Row by row, as a row names a feature once: arrays over all rows and features would be many times the rows themselves.
    weighed, seen = np.zeros((2, size)), np.zeros((2, size), np.int64)
    for (y, f, *_), w in zip(rows, weight, strict=True):
        weighed[y, f] += w
        seen[y, f] += 1
    (neg, pos), held = weighed, seen.sum(axis=0)
    total = np.array([(weight * (given == y)).sum() for y in (1, 0)])
    excess = np.where(held >= 4, (pos / total[0] - neg / total[1]) / np.sqrt((pos + neg + 1) / total.sum()), 0)
    ranked = np.argsort(-np.abs(excess), kind="stable")[:wanted]
    ranked = ranked[excess[ranked] != 0]
    number = np.full(size, -1)
    number[ranked] = np.arange(len(ranked))
    kept = [number[f] >= 0 for _, f, *_ in rows]
    row = np.repeat(np.arange(n, dtype=np.int32), [k.sum() for k in kept])
    column = np.concatenate([number[r[1][k]] for r, k in zip(rows, kept, strict=True)])
    value = np.log1p(np.concatenate([r[2][k] for r, k in zip(rows, kept, strict=True)]))
    by_column = np.argsort(column, kind="stable")
    cuts = np.searchsorted(column[by_column], np.arange(len(ranked) + 1))
    patterns = np.array([r[3] for r in rows], np.int64)
    columns = [(patterns >> b) & 1 for b in range(len(PATTERNS))]
    n1, n0 = ((given == y).sum() for y in (1, 0))
    rows0, rows1 = seen[:, ranked]
    share = (rows1 + rows0) / n
    surprise = (rows1 / n1 - rows0 / n0) / np.sqrt(share * (1 - share + 1 / n) * (1 / n1 + 1 / n0))
    lift = (rows1 + 0.5) / n1 / ((rows0 + 0.5) / n0)
    for c in np.flatnonzero((surprise >= SURPRISE) & (lift >= LIFT)):
        if len(columns) >= voters + len(PATTERNS):
            break
        vote = np.zeros(n, np.int64)
        vote[row[by_column[cuts[c] : cuts[c + 1]]]] = 1
        if all((vote & x).sum() < 0.95 * (vote | x).sum() for x in columns[len(PATTERNS) :]):  # not the same voter again
            columns.append(vote)
    votes = np.column_stack(columns)
    heard = votes[:, PATTERNS.index("lexicon") :].sum(axis=1)
    rate = float(np.clip(total[0] / total.sum(), 1e-3, 0.999))
    label_model, posterior = fit_label_model(votes, weight, np.array([0.02, 0.5, 0.98])[np.minimum(heard, 2)], rate)
    some, bias = fit_linear(row, column, value, n, len(ranked), posterior, weight)
    scale, shift = calibrate(np.bincount(row, some[column] * value, n) + bias, given, weight)
    weights = np.zeros(size)
    weights[ranked] = scale * some
    bias = scale * bias + shift
    chosen = np.zeros(size, bool)
    chosen[ranked] = True
    return Toxicity(chosen, weights.astype(np.float32), bias, label_model)


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text has this remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, out = utf8(b.column(1)), []
        text, feature, count, votes = features(raw)
        cuts = np.searchsorted(text, np.arange(len(raw) + 1))
        for k in range(len(raw)):
            x = slice(cuts[k], cuts[k + 1])
            out.append(pack(f=feature[x].astype(np.uint32), c=count[x].astype(np.uint32), v=votes[k : k + 1]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["label", "blob"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, sample: int = SAMPLE) -> Toxicity:
    """Fits on labelled documents outside the held-out fold; of ids with several labels the greatest counts, and null labels don't."""
    lean()
    own = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), (F.col(f"`{label_col}`") > 0).cast("int").alias("label"))
    own = own.where(~held_out(F.col("id"), FOLDS, HELD_OUT)).groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    rate = {y: min(1.0, (sample if y else 2 * sample) / max(counts.get(y, 0), 1)) for y in (0, 1)}
    draw = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < F.when(F.col("label") == 1, F.lit(int(rate[1] * (1 << 30)))).otherwise(F.lit(int(rate[0] * (1 << 30))))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # An id and a label for each sampled row: about 3 * sample rows whatever the tables' size, so texts needn't be shuffled to meet them.
    rows = texts.join(F.broadcast(own.where(draw)), "id").select("label", "text").mapInArrow(_features_of, "label int, blob binary").orderBy("label", F.xxhash64("blob")).collect()
    parts = [(r["label"], (x := unpack(bytes(r["blob"])))["f"], x["c"], int(x["v"][0])) for r in rows]
    weight = np.array([1 / max(rate[p[0]], 1e-9) for p in parts])
    return fit(parts, weight / max(weight.mean(), 1e-9) if len(weight) else weight)


def restored(at: np.ndarray, some: np.ndarray, bias: float) -> Toxicity:
    """The classifier from its chosen features alone."""
    chosen, weights = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.float32)
    chosen[at], weights[at] = True, some
    return Toxicity(chosen, weights, bias, LabelModel())


def scored(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text", *, least_score: float = LEAST_SCORE) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row; a null text scores as an empty one, a null id stays null, repeated rows repeat."""
    at = np.flatnonzero(model.chosen)
    slim = at, model.weights[at], model.bias

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        own = restored(*slim)
        for b in batches:
            score = own.score(utf8(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= least_score).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    key = F.col(f"`{id_col}`")
    rows = docs.select(key.cast("long").alias("id"), held_out(key, FOLDS, HELD_OUT).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(mapped, "id bigint, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of `docs`, with all their columns, that aren't predicted toxic; one pass without a join."""
    model = train(docs, labels, id_col, text_col)
    at = np.flatnonzero(model.chosen)
    slim, place = (at, model.weights[at], model.bias), docs.columns.index(text_col)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        own = restored(*slim)
        for b in batches:
            yield b.filter(pa.array(own.score(utf8(b.column(place))) < least_score))

    return docs.mapInArrow(mapped, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, train(docs, labels))
