"""Benchmark decontamination: pairs of rare seed words, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import chunks, spread, utf8, word_hashes

#: The least score of a copy: in matched words (the whole item if it has fewer), and as a share of the item's words.
SEED_WORDS, LEAST_SCORE = 4, 0.5
MISMATCH, GAP = 0.5, 0.5
#: Seeds of an item that must stand near each other, and seed hits that are held together.
TOGETHER = 4
HITS = 1 << 21
#: Benchmark bytes that one pass over the documents holds in each task; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def normal_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded buffer, word bounds, and each text's first word: runs of ASCII letters, digits and non-ASCII characters other than punctuation and spaces, with A-Z and the capitals of Latin-1 in lower case."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    buffer = _FOLD[raw]
    latin = np.flatnonzero(raw[:-1] == 0xC3) + 1
    latin = latin[(raw[latin] >= 0x80) & (raw[latin] <= 0x9E) & (raw[latin] != 0x97)]
    buffer[latin] += 32
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _LETTER[buffer]
    # Punctuation and spaces beyond ASCII: U+00A0 to U+00BF but for letters, U+2000 to U+206F, U+3000 to U+301F.
    pair = np.flatnonzero(raw[:-1] == 0xC2) + 1
    pair = pair[(raw[pair] >= 0xA0) & ~np.isin(raw[pair], (0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA))]
    triple = np.flatnonzero((raw[:-2] == 0xE2) | (raw[:-2] == 0xE3)) + 1
    triple = triple[np.where(raw[triple - 1] == 0xE2, (raw[triple] == 0x80) | (raw[triple] == 0x81), (raw[triple] == 0x80) & (raw[np.minimum(triple + 1, len(raw) - 1)] < 0xA0))]
    for at, width in ((pair - 1, 2), (triple - 1, 3)):
        for k in range(width):
            inside[1 + at + k] = False
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return buffer, edges[::2], edges[1::2], np.searchsorted(edges[::2], begins)


class Lookup:
    """Which passages can hold a copy of an item of a block, by a condition that every copy meets.

    A score of `floor` needs as many matched words, so of an item's words any choice that leaves out `need` - k has k matched ones, k being at most `TOGETHER`.
    The choice takes the rarest. Between the ends of a copy at most `room` words are inserted.
    """

    def __init__(self, items: list[tuple[int, bytes]], n: int, least: float) -> None:
        buffer, start, end, first = normal_words([t for _, t in items])
        hashes = word_hashes(buffer, start, end)
        self.ids = [i for i, _ in items]
        self.words = [hashes[first[k] : first[k + 1]] for k in range(len(items))]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.floor = np.maximum(least * self.size, np.minimum(self.size, n))
        self.need = np.maximum(np.ceil(self.floor - 1e-9), 1).astype(np.int64)
        self.together = np.minimum(self.need, TOGETHER)
        self.room = np.maximum(np.floor((self.size - self.floor) / GAP + 1e-9), 0).astype(np.int64)
        self.vocabulary = np.unique(hashes)
        self.distinct = [np.unique(w, return_counts=True) for w in self.words]

    def count(self, words: np.ndarray) -> np.ndarray:
        """How often each word of the vocabulary stands in `words`."""
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        return np.bincount(at[self.vocabulary[at] == words], minlength=len(self.vocabulary))

    def choose(self, frequency: np.ndarray) -> None:
        """Takes each item's rarest words as seeds; `frequency` decides about the cost alone."""
        seeds: dict[tuple[int, int], tuple[int, int]] = {}
        for k, w in enumerate(self.words):
            if 0 < self.need[k] <= len(w):
                rank = np.argsort(frequency[np.searchsorted(self.vocabulary, w)], kind="stable")
                for p in rank[: len(w) - self.need[k] + self.together[k]].tolist():
                    near, far = seeds.get((int(w[p]), k), (p, p))
                    seeds[int(w[p]), k] = min(near, p), max(far, p)
        rows = sorted((g, k, *place) for (g, k), place in seeds.items())
        self.seed = np.array([r[0] for r in rows], np.uint64)
        self.item, self.near, self.far = (np.array([r[c] for r in rows], np.int64) for c in (1, 2, 3))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.seed >> np.uint64(44)).astype(np.int64)] = True

    def regions(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Text, item, first word and end of each stretch of a text around seeds of an item."""
        at = np.flatnonzero(self.seen[(words >> np.uint64(44)).astype(np.int64)])
        a = np.searchsorted(self.seed, words[at])
        count = np.searchsorted(self.seed, words[at], "right") - a
        at, a, count = at[count > 0], a[count > 0], count[count > 0]
        text = np.searchsorted(first, at, "right") - 1
        done = 0
        while done < len(at):
            # A text's hits stay together.
            stop = int(np.searchsorted(np.cumsum(count[done:]), HITS)) + done
            stop = int(np.searchsorted(text, text[min(stop, len(at) - 1)])) if stop < len(at) else len(at)
            stop = stop if stop > done else int(np.searchsorted(text, text[done], "right"))
            owner, nth = spread(count[done:stop])
            x = a[done:stop][owner] + nth
            yield from self._near(text[done:stop][owner], at[done:stop][owner] - first[text[done:stop][owner]], x, np.diff(first))
            done = stop

    def hopeful(self, passage: np.ndarray, item: int) -> bool:
        """False if no alignment can reach the score: too few of the item's words, each counted as often as both sides have it, or too many others between them."""
        words, often = self.distinct[item]
        at = np.minimum(np.searchsorted(words, passage), len(words) - 1)
        same = words[at] == passage
        if np.minimum(np.bincount(at[same], minlength=len(words)), often).sum() < self.need[item]:
            return False
        gain = np.zeros(len(passage) + 1)
        np.cumsum(np.where(same, 1.0, -min(MISMATCH, GAP)), out=gain[1:])
        return bool((gain - np.minimum.accumulate(gain)).max() >= self.floor[item] - 1e-9)

    def _near(self, text: np.ndarray, pos: np.ndarray, x: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        o = np.lexsort((pos, self.item[x], text))
        text, pos, x = text[o], pos[o], x[o]
        item = self.item[x]
        # Hit i and the last of the `together` hits from it on are of one text and item, and no further apart than the ends of a copy.
        last = np.arange(len(o)) + self.together[item] - 1
        ok = last < len(o)
        last = np.minimum(last, len(o) - 1)
        ok &= (text[last] == text) & (item[last] == item) & (pos[last] - pos < (self.size + self.room)[item])
        cover = np.zeros(len(o) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(ok), 1)
        np.add.at(cover, last[ok] + 1, -1)
        keep = np.cumsum(cover[:-1]) > 0
        text, pos, x, item = text[keep], pos[keep], x[keep], item[keep]
        if not len(text):
            return
        low = np.maximum(pos - self.far[x] - self.room[item], 0)
        high = np.minimum(pos - self.near[x] + self.size[item] + self.room[item], length[text])
        o, group = _regions(text, item, low, high)
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        yield from zip(text[o][cuts].tolist(), item[o][cuts].tolist(), np.minimum.reduceat(low[o], cuts).tolist(), np.maximum.reduceat(high[o], cuts).tolist(), strict=True)


def align(passage: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman over words: best score, and the span of the passage that has it. A match counts 1; a gap's row is settled at once by a running maximum."""
    n = len(passage)
    ramp = GAP * np.arange(n + 1)
    above, from_above = np.zeros(n + 1), np.arange(n + 1)
    best = (0.0, 0, 0)
    index = np.arange(n + 1)
    for w in item:
        step = above[:-1] + np.where(passage == w, 1.0, -MISMATCH)
        down = above - GAP
        row, origin = down.copy(), from_above.copy()
        better = step >= row[1:]
        row[1:][better], origin[1:][better] = step[better], from_above[:-1][better]
        lift = row + ramp
        top = np.maximum.accumulate(lift)
        source = np.maximum.accumulate(np.where(lift == top, index, 0))
        row, origin = top - ramp, origin[source]
        none = row <= 0
        row[none], origin[none] = 0.0, index[none]
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (float(row[j]), int(origin[j]), j)
        above, from_above = row, origin
    return best


def _regions(text: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order by (text, item, low), and the number of the overlapping group of each hit's region."""
    o = np.lexsort((low, item, text))
    t, i, a, z = text[o], item[o], low[o], high[o]
    new = np.ones(len(o), bool)
    if len(o) > 1:
        same = (t[1:] == t[:-1]) & (i[1:] == i[:-1])
        block = np.cumsum(np.concatenate([[True], ~same]))
        shift = np.int64(z.max() + 1)
        reach = np.maximum.accumulate(z + block * shift)
        new[1:] = ~same | (a[1:] + block[1:] * shift > reach[:-1])
    return o, np.cumsum(new) - 1


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def frequencies(texts: DataFrame, look: Lookup) -> np.ndarray:
    """How often each word of the items stands in all texts. At most a block's vocabulary comes to the driver."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(look.vocabulary), np.int64)
        for b in batches:
            raw = utf8(b.column(1))
            for i, j in chunks(raw):
                total += look.count(word_hashes(*normal_words(raw[i:j])[:3]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["word", "n"])

    out = np.zeros(len(look.vocabulary), np.int64)
    if len(out):
        for r in texts.mapInArrow(mapped, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect():
            out[r["word"]] = r["n"]
    return out


def scored(texts: DataFrame, look: Lookup) -> DataFrame:
    """(id, item, score, first_word, end_word): the best alignment of each passage that holds a copy."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, rows = utf8(b.column(1)), []
            for i, j in chunks(raw):
                buffer, start, end, first = normal_words(raw[i:j])
                words = word_hashes(buffer, start, end)
                for text, item, low, high in look.regions(words, first):
                    passage = words[first[text] + low : first[text] + high]
                    if not look.hopeful(passage, item):
                        continue
                    s, a, z = align(passage, look.words[item])
                    if s >= look.floor[item] - 1e-9:
                        rows.append((b.column(0)[i + text].as_py(), look.ids[item], s / len(look.words[item]), low + a, low + z))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()], strict=True)], ["id", "item", "score", "first_word", "end_word"])

    return texts.mapInArrow(mapped, "id bigint, item bigint, score double, first_word bigint, end_word bigint")


def blocks(items: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """The distinct (item, text), block by block, each of at most `limit` bytes or one item; read one block at a time."""
    slim = items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).distinct()
    held, size = [], 0
    for r in slim.orderBy("item", "text").toLocalIterator():
        t = r["text"].encode()
        if held and size + len(t) > limit:
            yield held
            held, size = [], 0
        held.append((r["item"], t))
        size += len(t)
    if held:
        yield held


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, seed_words: int = SEED_WORDS, least_score: float = LEAST_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, item_col, score, first_word, end_word) for each document and test item of which it holds a copy.

    Every passage that can reach the score is aligned with the item, whatever its edits: of an item's rarest words (by their count in all documents) two must
    stand near each other, and enough of its words in all. A match counts 1, a mismatch or a gap -0.5. A score of `least_score` times the item's words makes a copy,
    and of `seed_words` at least (a shorter item must stand as a whole).
    score is that share; the words first_word to end_word of the document are the aligned ones, in its best passage.

    Items are held in blocks of `block_bytes`, and each block takes a pass over the documents. An item
    without words matches nothing. Null texts are empty; documents and items with a null id are reported with a null id. Of texts
    that share an item id each is looked up, and the best passage of any of them is reported. Repeated documents are reported once. Empty tables give no rows.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], f"`{id_col}` bigint, `{item_col}` bigint, score double, first_word bigint, end_word bigint")
    texts = _texts(docs, id_col, text_col)
    for block in blocks(items, item_col, item_text_col, block_bytes):
        look = Lookup(block, seed_words, least_score)
        look.choose(frequencies(texts, look))
        out = out.union(scored(texts, look))
    best = out.groupBy(*(F.col(f"`{c}`") for c in out.columns[:2])).agg(F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word"))).alias("b"))
    return best.select(*(F.col(f"`{c}`") for c in out.columns[:2]), "b.*")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """The rows of `docs` that hold no copy of a test item; rows with a null id stay."""
    lost = contaminated(docs, items, id_col, text_col, **how).select(F.col(id_col).alias("__d_id")).distinct()
    return docs.join(lost, docs[f"`{id_col}`"] == lost["__d_id"], "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
