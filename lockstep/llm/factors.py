"""Relative Lempel-Ziv parsing of passages against a reference block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textkit import spread, words
from .windows import Passages, gathered


def word_ids(x: Passages) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal bytes, and each passage's first word."""
    begin = (np.cumsum(x.length) - x.length).tolist()
    data = x.text.tobytes()
    buffer, start, end, first = words([data[a : a + n] for a, n in zip(begin, x.length.tolist(), strict=True)])
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(gathered(buffer, start, size))])
    return array.dictionary_encode().indices.to_numpy().astype(np.uint32), first


def classes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers below 2**32, equal for equal pairs."""
    pair = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
    o = np.argsort(pair)
    pair = pair[o]
    new = np.ones(len(pair), bool)
    new[1:] = pair[1:] != pair[:-1]
    out = np.empty(len(pair), np.uint32)
    out[o] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return out


class Block:
    """A reference block: every passage of a range of anchors, indexed so that the longest factor from any of their places can be read off.

    The index numbers the word sequences by doubling (1, 2, 4, ... words, then `least` by two that overlap), which is a suffix order cut off at that depth, and
    then goes on word by word as long as a sequence also stands in a smaller document.
    """

    def __init__(self, ids: np.ndarray, x: Passages, least: int) -> None:
        word, first = word_ids(x)
        self.least, self.count = least, x.count
        self.begin = np.cumsum(x.count) - x.count
        owner, nth = spread(x.count)
        at, end = first[owner] + nth, first[owner + 1]
        span, number = 1, word
        while 2 * span <= least:
            number = classes(number[: len(number) - span], number[span:])
            span *= 2
        number = classes(number[at], number[at + least - span])
        self.length = np.zeros(len(at), np.int64)
        alive, size = np.arange(len(at)), least
        while len(alive):
            own = ids[owner[alive]]
            smallest = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(smallest, number, own)
            found = smallest[number] < own
            self.length[alive[found]] = size
            # A group in which no document comes later is of no use to longer factors.
            useful = np.zeros(len(smallest), bool)
            useful[number[found]] = True
            on = useful[number] & (at[alive] + size < end[alive])
            alive, number = alive[on], classes(number[on], word[at[alive[on]] + size])
            size += 1

    def parse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, begin and end of the factors of all passages, step by step from left to right.

        From a place with no factor of `least` words the parse goes on by a word. Behind a factor it goes on where the first string of `least` words
        crosses the factor's end, as that one may stand elsewhere: those inside the factor need no look.
        """
        out = []
        passage, cursor = np.arange(len(self.count)), np.zeros(len(self.count), np.int64)
        while len(passage):
            on = cursor < self.count[passage]
            passage, cursor = passage[on], cursor[on]
            length = self.length[self.begin[passage] + cursor]
            hit = length > 0
            out.append((passage[hit], cursor[hit], cursor[hit] + length[hit]))
            cursor = cursor + np.where(hit, np.maximum(length - self.least + 1, 1), 1)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def repeats(ids: np.ndarray, x: Passages, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, first word and end of each factor of `window` words or more that a smaller document has."""
    if not len(x.count):
        return (np.zeros(0, np.int64),) * 3
    block = Block(ids, x, window)
    which, start, end = block.parse()
    return which, x.start[which] + start, x.start[which] + end
