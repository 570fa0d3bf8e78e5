"""Whole texts as numpy arrays: words, word hashes and shingles of many documents at once.

Texts are laid end to end as code points. A word is a maximal run of letters and
digits (``str.isalnum``), and its hash is a polynomial of its code points, read
off one running sum, so no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points handled at once; longer single texts form a chunk of their own.
CHUNK = 1 << 18
SHINGLE = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def unit(h: np.ndarray) -> np.ndarray:
    """Hashes as doubles in (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


@lru_cache(1)
def alnum_table() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@lru_cache(1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK + (CHUNK >> 2)), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def chunks(texts: list[str], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` code points each."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def slices(batch: pa.RecordBatch, column: int, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values in ``column`` take about ``size`` bytes; a longer one is a slice of its own.

    Python objects are then made for a slice at a time, not for the whole batch.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(ends):
        reach = (ends[start - 1] if start else 0) + size
        stop = max(start + 1, int(np.searchsorted(ends, reach, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def one_of_each(batch: pa.RecordBatch, key: int, least: int) -> pa.RecordBatch:
    """The batch with one row of each value in column ``key``: that of the least value in ``least``, nulls last."""
    best: dict[int, tuple[int | None, int]] = {}
    for row, (k, x) in enumerate(zip(batch.column(key).to_pylist(), batch.column(least).to_pylist(), strict=True)):
        known = best.get(k)
        if known is None or (x is not None and (known[0] is None or x < known[0])):
            best[k] = (x, row)
    if len(best) == batch.num_rows:
        return batch
    return batch.take(pa.array([row for _, row in best.values()], pa.int64()))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, a line feed after each text, and where each text starts (one more than texts)."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return points, starts


def running(points: np.ndarray) -> np.ndarray:
    """Running polynomial sums: hash of [a, b) is (r[b] - r[a]) * inverse**a."""
    up, _ = powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last element must be False."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    return edge[::2], edge[1::2]


class Words:
    """The words of a chunk of texts.

    hashes: one for each word; first: index of each text's first word (one more
    than texts); start, end: code points of each word, counted from its text's start.
    """

    def __init__(self, texts: list[str], lower: bool = True, letters: bool = False):
        if lower:
            texts = [t.lower() for t in texts]
        self.points, self.starts = code_points(texts)
        begin, end = spans((letter_table() if letters else alnum_table())[self.points])
        self.sums = running(self.points)
        _, down = powers(len(self.points) + 1)
        self.hashes = mix((self.sums[end] - self.sums[begin]) * down[begin])
        self.first = np.searchsorted(begin, self.starts)
        self.begin, self.stop = begin, end

    def grams(self, begin: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the ``n`` code points from each of ``begin``; unlike those of words and other lengths."""
        _, down = powers(len(self.points) + 1)
        return mix(((self.sums[begin + n] - self.sums[begin]) * down[begin]) ^ np.uint64(n << 56 | n))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the runs of ``k`` words of each text.

    A text of fewer words has one shingle of all of them; one without words has none.
    """
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offsets = np.concatenate(([0], np.cumsum(counts)))
    total = int(offsets[-1])
    at = np.arange(total) - np.repeat(offsets[:-1], counts) + np.repeat(first[:-1], counts)
    left = np.repeat(n, counts)
    padded = np.concatenate((hashes, np.zeros(k, np.uint64)))
    out = np.zeros(total, np.uint64)
    for j in range(k):
        word = padded[at + j]
        if j:
            word = np.where(left > j, word, np.uint64(0))
        out = mix(out * np.uint64(3) + word)
    return out, offsets


def occurrences(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """0 for the first time a value stands in its group, 1 for the second, and so on."""
    order = np.lexsort((values, groups))
    v, g = values[order], groups[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    begin = np.flatnonzero(new)
    nth = np.arange(len(v)) - np.repeat(begin, np.diff(np.append(begin, len(v))))
    out = np.empty(len(v), np.int64)
    out[order] = nth
    return out


def texts_of(column) -> list[str]:
    """A pandas or Arrow column as texts; null counts as empty."""
    values: Iterable = column.to_pylist() if hasattr(column, "to_pylist") else column
    return [v if isinstance(v, str) else "" for v in values]


class Lookup:
    """Rows of a table by 64-bit hash; most misses are told by a bitmap."""

    BITS = 20

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.map = np.zeros(1 << self.BITS, bool)
        self.map[self._slot(hashes)] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``hashes`` are in the table, their rows)."""
        maybe = np.flatnonzero(self.map[self._slot(hashes)])
        if not len(self.sorted) or not len(maybe):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        wanted = hashes[maybe]
        at = np.minimum(np.searchsorted(self.sorted, wanted), len(self.sorted) - 1)
        hit = self.sorted[at] == wanted
        return maybe[hit], self.order[at[hit]]


def release() -> None:
    """Hand freed memory back to the system, so that an idle Python worker keeps little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass
