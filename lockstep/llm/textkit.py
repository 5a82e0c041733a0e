"""NumPy helpers over UTF-8 bytes: word bounds, position-free hashes, packed columns.

A rolling hash here is a sum of random symbol values times powers of an odd
base modulo 2**64; a difference of prefix sums, moved back to position 0 by the
base's inverse, is the hash of any slice at the cost of two reads.
"""

from __future__ import annotations

import ctypes
import pickle
import sys

import numpy as np
import pyarrow as pa

#: Bytes that end a word: space and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: A byte that no UTF-8 text holds; stands between texts.
PAD_BYTE = 0xFF

_BASE = 0x9E3779B97F4A7C15
_SYMBOLS = np.random.RandomState(20240229).randint(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


_LEAN: list[bool] = []


def lean() -> None:
    """Has this worker process give arrays back to the system as they are freed; else a reused worker keeps the most it ever held. Only the GNU allocator knows the setting."""
    if not _LEAN:
        _LEAN.append(True)
        pa.set_memory_pool(pa.system_memory_pool())
        if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "mallopt"):
            ctypes.CDLL(None).mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(base)
                done, base = 2 * done, base * base % (1 << 64)
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def lift(units: np.ndarray) -> np.ndarray:
    """Bytes become random 64-bit symbols; 64-bit units (word hashes) stay."""
    return _SYMBOLS[units] if units.dtype == np.uint8 else units


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    up, _ = _grow(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end] for each pair; equal slices have equal hashes wherever they stand."""
    _, down = _grow(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def gram_hashes(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k symbols."""
    _, down = _grow(len(sums))
    n = max(0, len(sums) - k)
    return mix((sums[k:] - sums[:n]) * down[:n]) if n else np.zeros(0, np.uint64)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w values, by doubling."""
    out, span = values, 1
    while 2 * span <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (w - span)], out[w - span :]) if span < w else out


def utf8(texts: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as bytes; null is empty."""
    return [b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = 1 << 20):
    """Slices of the list of about `limit` bytes, at least one text each."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def word_bounds(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that aren't white space."""
    inside = np.zeros(len(buffer) + 2, bool)
    np.logical_not(IS_SPACE[buffer], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def lower_ascii(buffer: np.ndarray) -> np.ndarray:
    """A-Z become a-z; other bytes stay."""
    return np.where((buffer >= 65) & (buffer <= 90), buffer | 32, buffer).astype(np.uint8)


def words(texts: list[bytes], lower: bool = False):
    """(buffer, start, end, first) of some texts: word i of text t is buffer[start:end] at first[t] + i."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        buffer = lower_ascii(buffer)
    start, end = word_bounds(buffer)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return buffer, start, end, np.searchsorted(start, begins)


def word_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each word, a piece of the buffer at a time."""
    if len(buffer) <= piece:
        return slice_hashes(prefix_sums(lift(buffer)), start, end)
    out, i = [], 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + piece, "right")))
        lo, hi = start[i], end[j - 1]
        out.append(slice_hashes(prefix_sums(lift(buffer[lo:hi])), start[i:j] - lo, end[i:j] - lo))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c: the index of each of sum(c) items, and its number within that index."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def pack(**columns: np.ndarray) -> bytes:
    """Columns as one compressed blob: bytes of equal weight stand together; sorted columns (name ends in _up) as differences."""
    head, planes = [], []
    for name, x in columns.items():
        head.append((name, x.dtype.str, len(x)))
        if name.endswith("_up") and len(x):
            x = np.concatenate([x[:1], np.diff(x)])
        planes.append(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes())
    return pickle.dumps((head, pa.compress(b"".join(planes) + b"\0", codec="zstd", asbytes=True)))


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    head, planes = pickle.loads(blob)
    raw = np.frombuffer(pa.decompress(planes, sum(np.dtype(t).itemsize * n for _, t, n in head) + 1, codec="zstd", asbytes=True), np.uint8)
    out, at = {}, 0
    for name, kind, n in head:
        dtype = np.dtype(kind)
        x = raw[at : at + dtype.itemsize * n].reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n)
        at += dtype.itemsize * n
        out[name] = np.cumsum(x, dtype=dtype) if name.endswith("_up") else x
    return out


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in sorted columns."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)
