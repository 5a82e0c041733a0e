"""Best-fit packing of tokenised documents, after Martello-Toth dominance reduction."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .packing import pack
from .shared import saved
from .textkit import lean, spread

CAPACITY, END = 2048, 0
#: Parts of texts, and words, whose ids a Python worker remembers, in each of two generations.
PARTS, WORDS = 100_000, 150_000
#: Bytes of texts, about, that are tokenised together.
SLICE = 5_000_000
#: Pieces of about so many rows are numbered together.
NUMBERED = 50_000
_STOP = "\x01"
_TOKENIZERS: dict[str, tuple] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary's words: itself if it can be printed, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


def _whole(word: str) -> bool:
    """Whether the tokenizer neither changes the word (beyond ASCII case) nor parts it: letters below U+0180, in lower case if they aren't ASCII."""
    return word.isalpha() and (word.isascii() or (word.islower() and max(word) < "\u0180"))


def _encoded(words: list[str], tokenizer: object) -> dict[str, bytes]:
    """Ids of each word. Plain words go to the model at once; others through the whole tokenizer, many as one text, with a sign between them that has an id of its own."""
    model, letters = tokenizer.model, _letters()
    out, rest, plain, found, ends = {}, [], [], [], [0]
    for w in words:
        if _whole(w):
            plain.append(w)
            found += [t.id for t in model.tokenize(w.lower() if w.isascii() else w.encode().decode("latin-1").translate(letters))]
            ends.append(4 * len(found))
        else:
            rest.append(w)
    whole = np.array(found, "<u4").tobytes()
    out.update((w, whole[a:z]) for w, a, z in zip(plain, ends[:-1], ends[1:], strict=True))
    stop = tokenizer.encode(_STOP, add_special_tokens=False).ids
    for a in range(0, len(rest), 1000):
        some = rest[a : a + 1000]
        ids = np.array(tokenizer.encode(f" {_STOP} ".join(some), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(ids == stop[0]) if len(stop) == 1 else np.zeros(0, int)
        if len(cuts) == len(some) - 1:
            out.update((w, ids[x:z].tobytes()) for w, x, z in zip(some, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True))
        else:  # a word holds the sign
            out.update((w, np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in some)
    return out


def _base(part: str) -> tuple[str, str]:
    """A word in letters whose first is lower case, and a full stop or comma after it; else the part itself. The tokenizer lowers case and parts words from signs, so ids add up."""
    if part.islower() and part.isalpha():
        return part, ""
    tail = part[-1:] if part.endswith((".", ",")) else ""
    word = part[: len(part) - len(tail)]
    if not word.isalpha():
        return part, ""
    first = word[0].lower()
    return (first + word[1:], tail) if len(first) == 1 else (part, "")


class _Recent:
    """Ids of what was looked up of late: once `limit` entries are new, those not asked for since the time before go."""

    def __init__(self, limit: int) -> None:
        self.limit, self.new, self.old = limit, {}, {}

    def ids(self, keys: list[str], make: Callable[[list[str]], dict[str, bytes]]) -> list[bytes]:
        """Ids of the keys; `make` gives those of the keys that aren't known."""
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new
        out = list(map(self.new.get, keys))
        lost = []
        for i, v in enumerate(out):
            if v is None:
                k = keys[i]
                v = out[i] = self.old.get(k)
                if v is None:
                    lost.append(i)
                else:
                    self.new[k] = v
        if lost:
            made = make([keys[i] for i in lost])
            self.new.update(made)
            for i in lost:
                out[i] = made[keys[i]]
        return out


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (unsigned, little-endian, 32 bits), and where each text's begin and the last one's end.

    The vocabulary drops white space, so a text's ids are those of its parts between blanks. Distinct parts are looked up once for all texts.
    """
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = (Tokenizer.from_file(path), _Recent(PARTS), _Recent(WORDS))
    tokenizer, known, words = _TOKENIZERS[path]
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    coded = split.flatten().dictionary_encode()
    parts = coded.dictionary.to_pylist()

    def of_words(some: list[str]) -> dict[str, bytes]:
        bases, tails = zip(*map(_base, some), strict=True)
        dot, comma, *own = words.ids([".", ",", *bases], lambda w: _encoded(list(dict.fromkeys(w)), tokenizer))
        ends = {"": b"", ".": dot, ",": comma}
        return {p: i + ends[t] for p, i, t in zip(some, own, tails, strict=True)}

    raw = known.ids(parts, of_words)
    size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    begin, at = np.cumsum(size) - size, coded.indices.to_numpy(zero_copy_only=False)
    owner, nth = spread(size[at])
    bounds = np.concatenate([[0], np.cumsum(size[at])])[split.offsets.to_numpy() - split.offsets[0].as_py()]
    return np.frombuffer(b"".join(raw), "<u4")[begin[at][owner] + nth], bounds


def pieces(docs: DataFrame, id_col: str, text_col: str, *, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the end id follows each document; longer ones are cut at multiples of the capacity."""
    end, width = np.array([END], "<u4").tobytes(), 4 * capacity

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // SLICE, prepend=0)) + 1
            bounds_of = sorted({0, *cuts.tolist(), len(texts)})
            for a, z in zip(bounds_of[:-1], bounds_of[1:], strict=True):
                owner, number, length, crc, raw = [], [], [], [], []
                tokens, bounds = token_ids(texts.slice(a, z - a), tokenizer)
                for k in range(z - a):
                    t = tokens[bounds[k] : bounds[k + 1]].tobytes() + end
                    for p, s in enumerate(range(0, len(t), width)):
                        part = t[s : s + width]
                        owner.append(a + k)
                        number.append(p)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            raw.append(np.frombuffer(part, "<u4").astype(np.int64))
                number = np.array(number, np.int32)
                columns = [ids.take(pa.array(owner, pa.int64())), pa.array(number), pa.array(number.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(raw, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(mapped, schema)


def slots(plan: list) -> dict[str, np.ndarray]:
    """For each length, in order of rank: from which rank on, the first sequence, copies in a sequence, and the first copy's offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for n, copies in pattern:
            rows.append((n, taken.get(n, 0), sequence, copies, offset))
            taken[n] = taken.get(n, 0) + copies * times
            offset += n * copies
        sequence += times
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "copies", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row a piece: id_col, piece, start, length, ids_crc32, sequence_id, offset [, ids].

    Only the counts of lengths (at most `capacity` rows) come to the driver; the plan for them has a size that depends on the capacity alone and goes to
    the tasks. Pieces of one length are numbered in a distributed way (counts for each length and hash bucket, then a row number in
    the bucket), so a length that a third of all pieces have stays spread.

    A null or empty text is one piece with the end id alone. Repeated rows are packed each. Rows with a null id are packed, with a null id. An empty table
    gives no rows. Other columns of `docs` aren't returned.
    """
    cut = saved(pieces(docs, id_col, text_col, tokenizer=tokenizer or vocabulary(), capacity=capacity, with_ids=with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = slots(pack(counts, capacity))
    buckets = max(1, -(-sum(counts.values()) // NUMBERED))
    dealt = cut.withColumn("h", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "h").count().select("length", "h", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "h").orderBy("id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rn", F.row_number().over(within) - 1).join(bases, ["length", "h"])
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan["length"] * (1 << 45) + plan["rank"]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 45) + rank, "right") - 1
            r = rank - plan["rank"][at]
            sequence = plan["sequence"][at] + r // plan["copies"][at]
            offset = plan["offset"][at] + r % plan["copies"][at] * length
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids + ", sequence_id bigint, offset bigint"
    out = ranked.select(*names, (F.col("rn") + F.col("base")).cast("long").alias("rank")).mapInArrow(place, schema)
    return out.withColumnRenamed("id", id_col)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
