"""Most-significant-digit radix sort of suffixes, only as deep as a threshold."""

from __future__ import annotations

import numpy as np

from .textkit import runs
from .windows import Passages

#: Bytes of a digit, and suffixes that are sorted together (more only where they share the first digit).
DIGIT, TOGETHER = 8, 1 << 20


def digit(buffer: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The `width` bytes from each place on, as a number whose order is theirs."""
    out = np.zeros(len(at), np.uint64)
    for i in range(width):
        out <<= np.uint64(8)
        out |= buffer[at + i].astype(np.uint64)
    return out


def repeated(buffer: np.ndarray, at: np.ndarray, owner: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes agree through `depth` bytes with one of a smaller id; ids[owner] are theirs.

    Suffixes are parted by their first digit, then ordered group by group by one digit after the other. A group within
    one document is left after each pass. The groups after the last digit are exactly the strings of `depth` bytes in several documents.
    """
    later = np.zeros(len(at), bool)
    first = digit(buffer, at, min(DIGIT, depth))
    whole = np.argsort(first, kind="stable").astype(np.int32)
    bounds = np.append(runs(first[whole]), len(whole))
    a = 0
    while a < len(whole):
        z = int(bounds[max(np.searchsorted(bounds, a + TOGETHER, "right") - 1, np.searchsorted(bounds, a, "right"))])
        alive = whole[a:z]
        group = first[alive]
        for d in range(0, depth, DIGIT):
            if d:
                key = digit(buffer, at[alive] + d, min(DIGIT, depth - d))
                o = np.lexsort((key, group))
                alive, group, key = alive[o], group[o], key[o]
                begin = runs(group, key)
            else:
                begin = runs(group)
            if not len(alive):
                break
            size, own = np.diff(np.append(begin, len(alive))), ids[owner[alive]]
            least, most = (f.reduceat(own, begin) for f in (np.minimum, np.maximum))
            several = np.repeat(least < most, size)
            group = np.repeat(np.arange(len(begin), dtype=np.int32), size)[several]
            alive, least = alive[several], np.repeat(least, size)[several]
        if len(alive):
            later[alive] = ids[owner[alive]] > least
        a = z
    return later


def repeats(ids: np.ndarray, x: Passages, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, first byte and end of each window that also starts in a smaller document."""
    owner = np.repeat(np.arange(len(x.count), dtype=np.int32), x.count)
    # Windows of passages follow each other by a byte, passages by their length.
    skip = (np.cumsum(x.length) - x.length - np.cumsum(x.count) + x.count).astype(np.int64)
    at = (np.arange(len(owner)) + skip[owner]).astype(np.int32 if len(x.text) < 2**31 else np.int64)
    later = np.flatnonzero(repeated(x.text, at, owner, ids, window))
    which = owner[later].astype(np.int64)
    start = x.start[which] + later - (np.cumsum(x.count) - x.count)[which]
    return which, start, start + window
