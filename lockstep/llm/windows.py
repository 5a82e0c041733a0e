"""Which fixed-length windows of a document also start in a document with a smaller id.

Sending every suffix through every pass would move many times the data, so two passes over hashes leave those that can repeat, and
their text is then compared as it is, by the operator's own method:

1. *Anchors.* In each window the k-gram with the smallest hash is an anchor, so equal windows have equal anchors at
   equal offsets, and only about 2 of `window - k + 2` places are looked at. A k-gram that stands in one document only ends there.
2. *Contexts.* The anchor with `window - k` units on each side holds every window around it.
   Where a context stands in a smaller document too, all those windows repeat, however many copies there are.
3. *Passages.* What is left are the edges of repeats, one occurrence of each context. Their text, all windows of an anchor as one passage, goes to
   the anchor's block, and `find` tells which of the windows also start in a smaller document (see `radix` and `factors`).

Every pass combines before it shuffles: a task sends one document for each key, and settles the later ones itself. So a passage in a third of all
documents costs a row for each task. An anchor that has many contexts in one task's share (a common line with varied surroundings) is hot: that task sends two rows of it, and
everywhere its windows go out one by one by their own hashes, so no block gathers them. Data move as packed columns dealt by hash range, in buckets of a stated number of bytes;
beyond `FAN` buckets in two steps, so that blobs keep their size however many buckets there are. The texts are shuffled once, by document. Nothing is gathered on the driver but one sum of lengths.
Contexts are compared by 96 bits of hashes (of 10**13 anchors about one pair in ten thousand runs would agree by chance), passages by their text.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .textkit import PAD_BYTE, chunks, gram_hashes, lean, lift, mix, pack, prefix_sums, runs, slice_hashes, spread, unpack, utf8, window_min, word_hashes, words

#: Text bytes of a bucket, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 48
#: Anchors or windows that a task holds before it sorts and sends them.
FLUSH = 500_000
#: Buckets that a task deals out to directly.
FAN = 2048
#: An anchor with more contexts than this in one flush is hot.
CROWD = 8
#: Rows taken from a batch at once, and units hashed at once.
STEP = 256
SEGMENT = 1 << 18
WIRE = "bucket int, kind string, blob binary"
_PAD_WORD = np.uint64(0xA5A5A5A5DEADBEEF)
ID, TH, B, TEXT = "__w_id", "__w_th", "__w_b", "__w_text"


def layout(texts: list[bytes], unit: str, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Units of all texts with `pad` filler units around each, each text's first unit and number of units, and what gives the bytes of units from `at` on: buffer, begins, ends."""
    if unit == "byte":
        filler = bytes([PAD_BYTE]) * pad
        units = np.frombuffer(filler + filler.join(texts) + filler, np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        return units, pad + np.cumsum(size + pad) - size - pad, size, lambda at, n: (units, at, at + n)
    buffer, start, end, first = words(texts)
    hashes, size = word_hashes(buffer, start, end), np.diff(first)
    units = np.full(len(hashes) + pad * (len(texts) + 1), _PAD_WORD)
    owner, _ = spread(size)
    units[np.arange(len(hashes)) + pad * (owner + 1)] = hashes
    begin = pad + np.cumsum(size + pad) - size - pad

    def bytes_of(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word = at - pad * (np.searchsorted(begin, at, "right"))
        return buffer, start[word], end[word + n - 1]

    return units, begin, size, bytes_of


def segments(units: np.ndarray, halo: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(core begin, core end, offset, prefix sums): pieces that overlap by a halo on both sides."""
    for a in range(0, len(units), SEGMENT):
        lo, hi = max(0, a - halo), min(len(units), a + SEGMENT + halo)
        yield a, a + SEGMENT, lo, prefix_sums(lift(units[lo:hi]))


def anchors(texts: list[bytes], unit: str, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Text number, position, k-gram (48 bits) and context (48 bits) of each anchor."""
    pad, w = window - k, window - k + 1
    units, first, size, _ = layout(texts, unit, pad)
    found = []
    for a, b, lo, sums in segments(units, window) if (size >= window).any() else ():
        grams = gram_hashes(sums, k)
        if len(grams) < w:
            continue
        least, edge = window_min(grams, w), np.zeros(w - 1, np.uint64)
        top = ~window_min(~np.concatenate([edge, least, edge]), w)  # the largest window minimum of those that hold the position
        at = np.flatnonzero(grams == top) + lo
        at = at[(at >= a) & (at < b)]
        text = np.searchsorted(first, at, "right") - 1
        inside = (text >= 0) & (at + k <= first[text] + size[text]) & (size[text] >= window)
        at, text = at[inside], text[inside]
        context = slice_hashes(sums, at - pad - lo, at + k + pad - lo)
        found.append((text, at - first[text], grams[at - lo] >> np.uint64(16), context >> np.uint64(16)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@dataclass
class Passages:
    """Stretches of documents that hold `count` windows each: document, first unit, text and what they are routed by."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    length: np.ndarray
    text: np.ndarray

    @staticmethod
    def joined(parts: list[Passages]) -> Passages:
        return Passages(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Passages)))

    def where(self, keep: np.ndarray) -> Passages:
        begin = np.cumsum(self.length) - self.length
        return Passages(self.doc[keep], self.start[keep], self.count[keep], self.key[keep], self.length[keep], gathered(self.text, begin[keep], self.length[keep]))


#: Numbers that `gathered` indexes at once.
GATHER = 1 << 20


def gathered(buffer: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices of a buffer one after the other; indexes are made for a part of them at a time, as they take many times the room of bytes."""
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]) if len(ends) else 0, buffer.dtype)
    i = 0
    while i < len(length):
        done = int(ends[i] - length[i])
        j = max(i + 1, int(np.searchsorted(ends, done + GATHER, "right")))
        if j == i + 1:
            out[done : ends[i]] = buffer[begin[i] : begin[i] + length[i]]
        else:
            owner, nth = spread(length[i:j])
            out[done : ends[j - 1]] = buffer[begin[i:j][owner] + nth]
        i = j
    return out


def passages_at(texts: list[bytes], text: np.ndarray, pos: np.ndarray, unit: str, window: int, k: int, alone: bool) -> Passages:
    """The windows whose anchor stands at the given places: those of an anchor as one passage, keyed by the anchor, or each `alone`, keyed by itself."""
    pad, w = window - k, window - k + 1
    units, first, size, bytes_of = layout(texts, unit, pad)
    at = np.unique(first[text] + pos)
    none = np.zeros(0, np.int64)
    found = [Passages(none, none, none, np.zeros(0, np.uint64), none, np.zeros(0, np.uint8))]
    for a, b, lo, sums in segments(units, window):
        here = at[np.searchsorted(at, a) : np.searchsorted(at, b)]
        if not len(here):
            continue
        grams = gram_hashes(sums, k)
        least = window_min(grams, w)
        t = np.searchsorted(first, here, "right") - 1
        start = here[:, None] + np.arange(-pad, 1)
        keep = (start >= first[t][:, None]) & (start + window <= (first[t] + size[t])[:, None])
        keep &= least[np.clip(start - lo, 0, len(least) - 1)] == grams[here - lo][:, None]  # a run of starts, as the anchor is the least from one smaller k-gram to the next
        n = keep.sum(axis=1)
        if alone:
            start, t, n = start[keep], np.repeat(t, n), np.ones(n.sum(), np.int64)
            key = slice_hashes(sums, start - lo, start + window - lo)
        else:
            some = n > 0
            start, t, key, n = (here - pad + keep.argmax(axis=1))[some], t[some], grams[here - lo][some], n[some]
        buffer, begin, end = bytes_of(start, n + window - 1)
        found.append(Passages(t, start - first[t], n, key >> np.uint64(16), end - begin, gathered(buffer, begin, end - begin)))
    return Passages.joined(found)


def order(key: np.ndarray, ids: np.ndarray, context: np.ndarray | None) -> np.ndarray:
    """Sorts by key, then context, then id; only groups of equal keys pass to the later digits."""
    o = np.argsort(key)
    s = key[o]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    group = same[1:] | same[:-1]
    rest = o[group]
    o[group] = rest[np.lexsort((ids[rest], key[rest]) if context is None else (ids[rest], context[rest], key[rest]))]
    return o


class Docs:
    """The documents that packed columns refer to: id and text hash."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, ids: np.ndarray, th: np.ndarray) -> int:
        self.parts.append((ids, th))
        self.n += len(ids)
        return self.n - len(ids)

    def arrays(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.parts) > 1:
            self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))]
        return self.parts[0]


def sealed(docs: tuple[np.ndarray, ...], doc: np.ndarray, **columns: np.ndarray) -> bytes:
    """One blob of columns with the documents they use."""
    used, local = np.unique(doc, return_inverse=True)
    o = np.argsort(docs[0][used], kind="stable")
    rank = np.empty(len(o), np.uint16 if len(o) < 65536 else np.uint32)
    rank[o] = np.arange(len(o))
    used = used[o]
    return pack(i_up=docs[0][used], t=docs[1][used].astype(np.uint32), d=rank[local], **columns)


def dealt(kind: str, bucket: np.ndarray, docs: tuple[np.ndarray, ...], doc: np.ndarray, step: int = 1, **columns: np.ndarray) -> Iterator[tuple]:
    """A (bucket, kind, blob) for each bucket; rows keep their order within it. With `step` above 1 for each run of so many buckets, and the blob says which one a row goes to (see `refined`)."""
    if not len(bucket):
        return
    if step > 1:
        columns["b"] = bucket.astype(np.uint32)
        bucket = bucket // step
    o = np.argsort(bucket, kind="stable")
    s = bucket[o]
    cuts = np.append(runs(s), len(s))
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        x = o[a:z]
        yield int(s[a]), kind, sealed(docs, doc[x], **{n: c[x] for n, c in columns.items()})


def opened(blobs: list[bytes]) -> tuple[tuple[np.ndarray, ...], dict[str, np.ndarray]]:
    """The blobs' documents and columns, each as one; d counts through all documents."""
    docs, columns = Docs(), []
    for x in map(unpack, blobs):
        base = docs.add(x.pop("i_up"), x.pop("t").astype(np.int64))
        columns.append(x | {"d": x["d"].astype(np.uint32) + np.uint32(base)})
    return docs.arrays(), {n: np.concatenate([c[n] for c in columns]) for n in columns[0]} if columns else {}


def wire(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as small Arrow batches."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("blob", pa.binary())])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def settled(docs: tuple[np.ndarray, ...], doc: np.ndarray, key: np.ndarray, context: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order, and which of it has an equal (key, context) in a document with a smaller id."""
    ids = docs[0][doc]
    o = order(key, ids, context)
    begin = runs(key[o]) if context is None else runs(key[o], context[o])
    least = np.repeat(ids[o][begin], np.diff(np.append(begin, len(o))))
    return o, ids[o] > least


#: Equal shares into which anchors' keys are parted, as a power of two, and parts of a share.
SHARES, PARTS = 12, 15


def knots(w: int) -> np.ndarray:
    """48-bit keys between which equal shares of anchors lie, if an anchor is the least of w hashes.

    A hash u (from 0 to 1) is the least in one of the w windows around it with chance (1 - u)**(w - 1) * (1 + (w - 1) * u), so small keys are many; this inverts the integral.
    """
    u = 1 - (1 - np.linspace(0, 1, 1 << 16)) ** (1 / w)
    q = (1 - u) ** w
    below = (w + 1) / 2 * ((1 - q) / w + (w - 1) * ((1 - q * (1 - u)) / (w * (w + 1)) - u * q / w))
    out = (np.interp(np.linspace(0, 1, (1 << SHARES) + 1), below, u) * (1 << 48)).astype(np.uint64)
    out[0], out[-1] = 0, 1 << 48
    return out


def bucket_of(key: np.ndarray, edges: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of keys that hold about as many anchors each; in whole numbers, so the same wherever it is computed."""
    share = np.searchsorted(edges, key, "right") - 1
    low = edges[share]
    part = ((key - low) << np.uint64(PARTS)) // (edges[share + 1] - low)
    return ((((share.astype(np.uint64) << np.uint64(PARTS)) + part) * np.uint64(buckets)) >> np.uint64(SHARES + PARTS)).astype(np.int32)


def send_anchors(batches: Iterator[pa.RecordBatch], unit: str, window: int, k: int, buckets: int, flush: int, crowd: int, edges: np.ndarray, step: int = 1) -> Iterator[pa.RecordBatch]:
    """First pass, on the map side."""
    lean()

    def rows() -> Iterator[tuple]:
        docs, held, n = Docs(), [], 0
        for batch in batches:
            ids, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in (ID, TH))
            for at in range(0, batch.num_rows, STEP):
                texts = utf8(batch.column(TEXT).slice(at, STEP))
                for i, j in chunks(texts, SEGMENT):
                    text, pos, gram, context = anchors(texts[i:j], unit, window, k)
                    base = docs.add(ids[at + i : at + j], th[at + i : at + j])
                    held.append(((text + base).astype(np.uint32), pos.astype(np.uint32), gram, context))
                    n += len(text)
                    if n >= flush:
                        yield from flushed(docs, held)
                        docs, held, n = Docs(), [], 0
        yield from flushed(docs, held)

    def flushed(docs: Docs, held: list[tuple]) -> Iterator[tuple]:
        if not held:
            return
        doc, pos, gram, context = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        table = docs.arrays()
        o, later = settled(table, doc, gram, context)
        yield from dealt("s", table[1][doc[o[later]]] % buckets, table, doc[o[later]], step, p=pos[o[later]])
        o = o[~later]
        begin = runs(gram[o])
        size, ids = np.diff(np.append(begin, len(o))), table[0][doc[o]]
        least, most = (np.repeat(f.reduceat(ids, begin), size) for f in (np.minimum, np.maximum)) if len(o) else (ids, ids)
        hot = (np.repeat(size, size) > crowd) & (least < most)
        yield from dealt("h", table[1][doc[o[hot]]] % buckets, table, doc[o[hot]], step, p=pos[o[hot]])
        # Of a hot anchor the least and the greatest document stand for all.
        number = np.repeat(np.arange(len(begin)), size)
        sent = ~hot
        for end in (least, most):
            at = np.flatnonzero(hot & (ids == end))
            sent[at[runs(number[at])]] = True
        x = o[sent]
        yield from dealt("a", bucket_of(gram[x], edges, buckets), table, doc[x], step, k_up=gram[x], c=context[x], p=pos[x], f=hot[sent])

    return wire(rows())


def blobs_of(rows: pa.Table, kind: str) -> list[bytes]:
    return [b for k, b in zip(rows["kind"].to_pylist(), rows["blob"].to_pylist(), strict=True) if k == kind]


def passed(rows: pa.Table, *kinds: str) -> Iterator[tuple]:
    return ((b, k, x) for b, k, x in zip(*(rows[c].to_pylist() for c in ("bucket", "kind", "blob")), strict=True) if k in kinds)


def table_of(rows: Iterator[tuple]) -> pa.Table:
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("blob", pa.binary())])
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def meet_anchors(rows: pa.Table, buckets: int, step: int = 1) -> pa.Table:
    """Places whose whole context repeats (s), and places whose windows are to be compared by their text (q, and h where the anchor is hot)."""

    def out() -> Iterator[tuple]:
        yield from passed(rows, "s", "h")
        docs, x = opened(blobs_of(rows, "a"))
        if not x:
            return
        doc, pos, gram, context, flag = x["d"], x["p"], x["k_up"], x["c"], x["f"]
        o, later = settled(docs, doc, gram, context)
        ids, g = docs[0][doc[o]], gram[o]
        begin = runs(g)
        size = np.diff(np.append(begin, len(g)))
        several = np.minimum.reduceat(ids, begin) < np.maximum.reduceat(ids, begin)
        new = np.zeros(len(g), np.int64)
        new[runs(g, context[o])] = 1
        hot = np.logical_or.reduceat(flag[o], begin)
        several &= (np.add.reduceat(new, begin) > 1) | hot
        asked = np.repeat(several, size) & ~later & ~flag[o]
        for kind, which in (("q", asked & ~np.repeat(hot, size)), ("h", asked & np.repeat(hot, size))):
            yield from dealt(kind, docs[1][doc[o[which]]] % buckets, docs, doc[o[which]], step, p=pos[o[which]])
        later = o[later]
        yield from dealt("s", docs[1][doc[later]] % buckets, docs, doc[later], step, p=pos[later])

    return table_of(out())


def numbered(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (id, text hash) pairs of a bucket's texts, and each pair's row."""
    ids, th = (texts[c].to_numpy() for c in (ID, TH))
    o = np.lexsort((th, ids))
    o = o[runs(ids[o], th[o])] if len(o) else o
    return ids[o], th[o], o


def located(known: tuple[np.ndarray, ...], docs: tuple[np.ndarray, ...]) -> np.ndarray:
    """Row of each document that packed columns refer to."""
    ids, th, row = known
    pairs = np.empty(len(ids), [("i", np.int64), ("t", np.int64)])
    pairs["i"], pairs["t"] = ids, th
    want = np.empty(len(docs[0]), pairs.dtype)
    want["i"], want["t"] = docs[0], docs[1]
    return row[np.searchsorted(pairs, want)]


def covered(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans, as sorted spans that neither overlap nor touch."""
    if not len(row):
        return row, start, end
    o = np.lexsort((start, row))
    row, start, end = row[o], start[o].astype(np.int64), end[o].astype(np.int64)
    shift = np.int64(max(end.max(), 0) + 2)
    reach = np.maximum.accumulate(end + row * shift)
    new = np.ones(len(row), bool)
    new[1:] = start[1:] + row[1:] * shift > reach[:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(row)) - 1
    return row[begin], start[begin], reach[last] - row[begin] * shift


def context_spans(known: tuple[np.ndarray, ...], rows: pa.Table, size_of: np.ndarray, window: int, k: int) -> list[tuple[np.ndarray, ...]]:
    """Row, start and end of what the repeated contexts (s) and merged spans (m) cover."""
    out = []
    docs, x = opened(blobs_of(rows, "s"))
    if x:
        row, pos = located(known, docs)[x["d"]], x["p"].astype(np.int64)
        out.append((row, np.maximum(pos - (window - k), 0), np.minimum(pos + window, size_of[row])))
    docs, x = opened(blobs_of(rows, "m"))
    if x:
        out.append((located(known, docs)[x["d"]], x["p"].astype(np.int64), x["e"].astype(np.int64)))
    return out


def unit_counts(texts: list[bytes], unit: str) -> np.ndarray:
    if unit == "byte":
        return np.array([len(t) for t in texts], np.int64)
    out = [np.diff(words(texts[i:j])[3]) for i, j in chunks(texts)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


#: ids of passages' documents, and the passages: which passage, and first and last unit of a repeated stretch of it, as a window of it also starts in a document with a smaller id.
Find = Callable[[np.ndarray, Passages, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def asked_passages(known: tuple[np.ndarray, ...], raw: list[bytes], rows: pa.Table, kind: str, unit: str, window: int, k: int) -> Passages | None:
    """The passages around the places to look at, by text row."""
    docs, x = opened(blobs_of(rows, kind))
    if not x:
        return None
    row, pos = located(known, docs)[x["d"]], x["p"].astype(np.int64)
    o = np.argsort(row, kind="stable")
    row, pos = row[o], pos[o]
    asked = np.unique(row)
    some, found = [raw[i] for i in asked], []
    for i, j in chunks(some):
        a, z = np.searchsorted(row, [asked[i], asked[j - 1] + 1])
        part = passages_at(some[i:j], np.searchsorted(asked[i:j], row[a:z]), pos[a:z], unit, window, k, kind == "h")
        part.doc = asked[i:j][part.doc]
        found.append(part)
    return Passages.joined(found)


def dealt_passages(x: Passages, bucket: np.ndarray, docs: tuple[np.ndarray, ...], step: int = 1) -> Iterator[tuple]:
    """A (bucket, "w", blob) for each bucket, with the passages' text; `step` as in `dealt`."""
    fine, bucket = bucket.astype(np.uint32), bucket // step
    o = np.argsort(bucket, kind="stable")
    cuts = np.append(runs(bucket[o]), len(o))
    begin = np.cumsum(x.length) - x.length
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        at = o[a:z]
        yield int(bucket[o[a]]), "w", sealed(docs, x.doc[at].astype(np.uint32), p=x.start[at].astype(np.uint32), n=x.count[at].astype(np.uint32), l=x.length[at].astype(np.uint32), x=gathered(x.text, begin[at], x.length[at]), **({"b": fine[at]} if step > 1 else {}))


def block_of(key: np.ndarray, blocks: int) -> np.ndarray:
    """By a hash of the key: runs of one word have an anchor at every place, however large its key, so ranges of keys would be uneven here."""
    return (((mix(key) >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int32)


def send_passages(texts: pa.Table, rows: pa.Table, unit: str, window: int, k: int, buckets: int, find: Find, step: int = 1) -> pa.Table:
    """The text around the places to look at. Windows of hot anchors are settled here first, so of equal ones a single document goes out."""

    def out() -> Iterator[tuple]:
        known = numbered(texts)
        table = tuple(texts[c].to_numpy() for c in (ID, TH))
        raw = utf8(texts[TEXT])
        spans = context_spans(known, rows, unit_counts(raw, unit), window, k)
        x = asked_passages(known, raw, rows, "q", unit, window, k)
        if x:
            yield from dealt_passages(x, block_of(x.key, buckets), table, step)
        x = asked_passages(known, raw, rows, "h", unit, window, k)
        if x:
            which, start, end = find(table[0][x.doc], x, window)
            spans.append((x.doc[which], start, end))
            keep = np.ones(len(x.doc), bool)
            keep[which] = False
            x = x.where(keep)
            yield from dealt_passages(x, block_of(x.key, buckets), table, step)
        if spans:
            row, start, end = covered(*(np.concatenate(c) for c in zip(*spans, strict=True)))
            yield from dealt("m", table[1][row] % buckets, table, row, step, p=start.astype(np.uint32), e=end.astype(np.uint32))

    return table_of(out())


def meet_passages(rows: pa.Table, window: int, buckets: int, find: Find, step: int = 1) -> pa.Table:
    """The stretches of a block's passages that also stand in smaller documents."""

    def out() -> Iterator[tuple]:
        yield from passed(rows, "m")
        docs, x = opened(blobs_of(rows, "w"))
        if x:
            doc = x["d"]
            which, start, end = find(docs[0][doc], Passages(doc, x["p"].astype(np.int64), x["n"].astype(np.int64), doc, x["l"].astype(np.int64), x["x"]), window)
            yield from dealt("m", docs[1][doc[which]] % buckets, docs, doc[which], step, p=start.astype(np.uint32), e=end.astype(np.uint32))

    return table_of(out())


def refined(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows for runs of buckets, dealt out to the buckets; about `limit` bytes of blobs at a time. Rows that name their bucket already pass."""
    lean()

    def rows() -> Iterator[tuple]:
        held, size = {}, 0
        for batch in batches:
            for bucket, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if any(name == "b" for name, _, _ in pickle.loads(blob)[0]):
                    held.setdefault(kind, []).append(blob)
                    size += len(blob)
                else:
                    yield bucket, kind, blob
                if size > limit:
                    yield from dealt_again(held)
                    held, size = {}, 0
        yield from dealt_again(held)

    def dealt_again(held: dict[str, list[bytes]]) -> Iterator[tuple]:
        for kind, blobs in held.items():
            docs, x = opened(blobs)
            fine, doc = x.pop("b").astype(np.int64), x.pop("d")
            if kind == "w":
                yield from dealt_passages(Passages(doc, x["p"], x["n"], doc, x["l"].astype(np.int64), x["x"]), fine, docs)
            else:
                o = np.argsort(x["k_up"], kind="stable") if "k_up" in x else np.arange(len(doc))
                yield from dealt(kind, fine[o], docs, doc[o], **{n: c[o] for n, c in x.items()})

    return wire(rows())


Finish = Callable[[pa.Table, list[bytes], np.ndarray, np.ndarray, np.ndarray], dict[str, pa.Array]]


def finish_texts(texts: pa.Table, rows: pa.Table, unit: str, window: int, k: int, finish: Finish, names: list[str]) -> pa.Table:
    """Each text with its spans, merged; the same for rows that are equal in id and text."""
    known = numbered(texts)
    raw = utf8(texts[TEXT])
    spans = context_spans(known, rows, np.zeros(0, np.int64), window, k)
    row, start, end = covered(*(np.concatenate(c) for c in zip(*spans, strict=True))) if spans else (np.zeros(0, np.int64),) * 3
    ids, th = (texts[c].to_numpy() for c in (ID, TH))
    twin = located(known, (ids, th)) if len(ids) else np.zeros(0, np.int64)
    if len(row) and (twin != np.arange(len(twin))).any():  # repeated rows take the first one's spans
        a, z = np.searchsorted(row, twin), np.searchsorted(row, twin, "right")
        owner, nth = spread(z - a)
        at = a[owner] + nth
        row, start, end = owner, start[at], end[at]
    made = finish(texts, raw, row, start, end)
    kept = {c: texts[c] for c in texts.column_names if c not in (ID, TH, B, TEXT)}
    return pa.table([(kept | made)[n] for n in names], names=names)


def one(f: Callable[..., pa.Table], **fixed: object) -> Callable:
    """f with some arguments fixed, as applyInArrow wants it."""

    def call(table: pa.Table) -> pa.Table:
        lean()
        return f(table, **fixed)

    return call


def two(f: Callable[..., pa.Table], **fixed: object) -> Callable:
    def call(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        return f(left, right, **fixed)

    return call


def bucket_count(texts: DataFrame, column: Column, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for texts of this total size."""
    total = texts.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    return max(LEAST_BUCKETS, -(-total // bucket_bytes))


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, *, unit: str, window: int, k: int, find: Find, finish: Finish, adds: str, keep: bool = True, bucket_bytes: int = BUCKET_BYTES, flush: int = FLUSH, crowd: int = CROWD, fan: int = FAN) -> DataFrame:
    """Rows of `docs` with what `finish` makes of each text and its repeated spans.

    `unit` is "byte" or "word". `adds` is the schema of the columns that `finish` returns; an input column of that name
    (in any case) gives way. With `keep` the other columns of `docs` stay, without it only the id.

    A null text is empty. A row with a null id stays, and counts as a document smaller than all others. Rows with one id
    are one document to each other; equal rows get equal results.
    """
    if not 0 < k < window:
        raise ValueError("k must lie between 1 and window - 1")
    added = StructType.fromDDL(adds).fieldNames()
    stay = [f for f in docs.schema.fields if (keep or f.name == id_col) and f.name.lower() not in {a.lower() for a in added} and not f.name.startswith("__w_")]
    buckets = bucket_count(docs, F.col(f"`{text_col}`"), bucket_bytes)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)).cast("long"))
    th = F.xxhash64(text, key).bitwiseAND(F.lit(0xFFFFFFFF))
    own = [key.alias(ID), th.alias(TH), text.alias(TEXT)]
    whole = docs.select(*(F.col(f"`{f.name}`") for f in stay), *own, F.pmod(th, F.lit(buckets)).cast("int").alias(B))
    step = -(-buckets // fan)
    how = {"unit": unit, "window": window, "k": k}
    edges = knots(window - k + 1)

    def routed(rows: DataFrame) -> DataFrame:
        """A task's blob for a bucket shrinks with the number of buckets, so beyond `fan` of them rows go to a run of buckets first, where those of many tasks are dealt on."""
        return rows if step == 1 else rows.repartition(-(-buckets // step), "bucket").mapInArrow(partial(refined, limit=8 * BUCKET_BYTES), WIRE)

    sent = routed(docs.select(*own).mapInArrow(partial(send_anchors, buckets=buckets, flush=flush, crowd=crowd, edges=edges, step=step, **how), WIRE))
    met = routed(sent.groupBy("bucket").applyInArrow(one(meet_anchors, buckets=buckets, step=step), WIRE))
    asked = routed(whole.groupBy(B).cogroup(met.groupBy("bucket")).applyInArrow(two(send_passages, buckets=buckets, find=find, step=step, **how), WIRE))
    spans = routed(asked.groupBy("bucket").applyInArrow(one(meet_passages, window=window, buckets=buckets, find=find, step=step), WIRE))
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in stay), adds])
    return whole.groupBy(B).cogroup(spans.groupBy("bucket")).applyInArrow(two(finish_texts, finish=finish, names=[*(f.name for f in stay), *added], **how), shape)
