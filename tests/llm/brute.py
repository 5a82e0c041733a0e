"""Plain versions of the contracts, over lists of (id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(units_of, docs, width):
    """Per document the positions that a repeated window covers."""
    first = {}
    for i, units in sorted(((i, units_of(t)) for i, t in docs), key=lambda x: x[0]):
        for p in range(len(units) - width + 1):
            first.setdefault(tuple(units[p : p + width]) if not isinstance(units, bytes) else units[p : p + width], i)
    out = []
    for i, t in docs:
        units, hit = units_of(t), set()
        for p in range(len(units) - width + 1):
            w = units[p : p + width] if isinstance(units, bytes) else tuple(units[p : p + width])
            if first[w] < i:
                hit.update(range(p, p + width))
        out.append((i, units, hit))
    return out


def op2(docs, width=50):
    out = {}
    for i, units, hit in covered(lambda t: (t or "").encode(), docs, width):
        spans = sum(1 for p in hit if p - 1 not in hit)
        kept = bytes(b for p, b in enumerate(units) if p not in hit)
        out[i] = (len(units), len(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


def op9(docs, width=13):
    out = {}
    for i, units, hit in covered(lambda t: WORD.findall(t or ""), docs, width):
        kept = " ".join(w for p, w in enumerate(units) if p not in hit).encode()
        out[i] = (len(units), len(hit), hashlib.sha256(kept).hexdigest())
    return out


def fingerprint(text, n=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(prints, radius=2):
    """Root of each of the (id, fingerprint)."""
    parent = {i: i for i, _ in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, fa in prints:
        for b, fb in prints:
            if a < b and (fa ^ fb).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in parent}


def op10(docs):
    prints = [(i, fingerprint(t)) for i, t in docs]
    roots = components_of(prints)
    return {i: (f"{f:016x}", roots[i]) for i, f in prints}


def op4(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    hit = {p + d for p, g in enumerate(grams) if often[g] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def best_sum(counts, capacity):
    """Fewest bins for a small multiset of lengths, by trying all."""
    lengths = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0] and k < len(lengths):
            return
        if k == len(lengths):
            best[0] = min(best[0], len(rooms))
            return
        for r in {*rooms}:
            if r >= lengths[k]:
                i = rooms.index(r)
                place(k + 1, rooms[:i] + [r - lengths[k]] + rooms[i + 1 :])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


def groups(pairs):
    out = defaultdict(set)
    for k, v in pairs:
        out[k].add(v)
    return out


def fewest(lengths, capacity):
    """A lower bound of bins (Martello and Toth's second): for each a, items over capacity - a are alone, those over half stand apart, and those from a on fill what is left."""
    best = 0
    for a in sorted({n for n in lengths if 2 * n <= capacity} | {0}):
        alone = sum(1 for n in lengths if n > capacity - a)
        half = [n for n in lengths if capacity - a >= n > capacity / 2]
        small = sum(n for n in lengths if capacity / 2 >= n >= a)
        best = max(best, alone + len(half) + max(0, -(-(small - len(half) * capacity + sum(half)) // capacity)))
    return best
