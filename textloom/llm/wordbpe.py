"""Token ids of many texts at once, for a word-level BPE tokenizer file.

The tokenizer splits lower-cased text into words before it merges anything. Words
are found over all texts of a slice as arrays, each distinct one is merged once
(all of a slice side by side: a round joins, in every word, the leftmost of the
pairs of least rank), and the ids of words met before are remembered in sorted
arrays. No Python object is made for a word. Texts with characters whose splitting
or lower case might differ between libraries go to the tokenizer itself, whole.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np

from textloom.llm.textvec import code_points, mix, powers, running

END = 1
#: Words whose ids a Python worker remembers within a task.
REMEMBERED = 400_000
#: Bytes of a word that are merged side by side; longer words are merged by the tokenizer.
LONGEST = 40
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
_APOSTROPHE, _LESS, _BAR = (ord(c) for c in "'<|")
_UNKNOWN = np.int32(np.iinfo(np.int32).max)
#: What the tokenizer splits off after an apostrophe (fixed values of its file).
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def _kinds() -> np.ndarray:
    """The kind of each code point up to the general punctuation; all others are odd."""
    kinds = np.full(0x2028, ODD, np.int8)
    for c in (*range(0x250), *range(0x2010, 0x2028)):
        category = unicodedata.category(chr(c))
        kinds[c] = SPACE if chr(c).isspace() else LETTER if category[0] == "L" else NUMBER if category[0] == "N" else OTHER
    kinds[0x1C:0x20] = ODD  # space to one library only
    return kinds


def _byte_characters() -> list[str]:
    """The character that byte-level BPE files write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


def _utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each code point starts) of code points of three bytes at most."""
    width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF)
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    if at[-1] == len(points):
        return points.astype(np.uint8), at
    raw, first = np.empty(at[-1], np.uint8), at[:-1]
    raw[first[width == 1]] = points[width == 1]
    for n, lead in ((2, 0xC0), (3, 0xE0)):
        some, place = points[width == n], first[width == n]
        raw[place] = lead | some >> (6 * (n - 1))
        for k in range(1, n):
            raw[place + k] = 0x80 | some >> (6 * (n - 1 - k)) & 0x3F
    return raw, at


class Merges:
    """The merge table of a tokenizer file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        names = _byte_characters()
        self.inner = np.array([vocab[c] for c in names], np.int32)
        self.last = np.array([vocab[c + suffix] for c in names], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([(vocab[a] << 16) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x9E3779B1)) >> np.int64(7)) & np.int64((1 << 20) - 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; the largest integer where there is none."""
        keys = (left.astype(np.int64) << 16) | right
        out = np.full(keys.shape, _UNKNOWN, np.int32)
        some = np.nonzero(self.maybe[self._slot(keys)])
        wanted = keys[some]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == wanted, self.rank[at], _UNKNOWN)
        return out

    def __call__(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths) of words given as ``length`` bytes of ``raw`` from ``start``.

        Words are taken from the longest down: after a round all words that could
        be joined have one symbol less and meet those that were as short before.
        """
        out_start, out_length = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        out, filled = [], 0
        order = np.argsort(length, kind="stable")
        ends = np.searchsorted(length[order], np.arange(int(length.max(initial=0)) + 2))
        symbols, ranks, who = np.zeros((0, 0), np.int32), np.zeros((0, 0), np.int32), np.zeros(0, np.int64)
        for n in range(len(ends) - 2, 0, -1):
            fresh = order[ends[n] : ends[n + 1]]
            if len(fresh):
                raws = raw[start[fresh][:, None] + np.arange(n)]
                new = self.inner[raws]
                new[:, -1] = self.last[raws[:, -1]]
                known = self.ranks(new[:, :-1], new[:, 1:])
                symbols = np.concatenate((symbols, new)) if len(who) else new
                ranks = np.concatenate((ranks, known)) if len(who) else known
                who = np.concatenate((who, fresh))
            if not len(who):
                continue
            if n > 1:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(who)), at]
                going = best != _UNKNOWN
                ended = np.flatnonzero(~going)
            else:
                ended = np.arange(len(who))
            out_start[who[ended]] = filled + n * np.arange(len(ended))
            out_length[who[ended]] = n
            out.append(symbols[ended].ravel())
            filled += n * len(ended)
            if n == 1 or len(ended) == len(who):
                symbols, ranks, who = symbols[:0, : n - 1], ranks[:0, : max(n - 2, 0)], who[:0]
                continue
            symbols, ranks, who, at, best = symbols[going], ranks[going], who[going], at[going], best[going]
            rows, columns = np.arange(len(who)), np.arange(n - 1)
            joined = self.merged[best]
            symbols = np.take_along_axis(symbols, columns[None, :] + (columns[None, :] > at[:, None]), axis=1)
            symbols[rows, at] = joined
            if n > 2:
                columns = columns[:-1]
                ranks = np.take_along_axis(ranks, columns[None, :] + (columns[None, :] >= at[:, None]), axis=1)
                left = np.flatnonzero(at > 0)
                ranks[left, at[left] - 1] = self.ranks(symbols[left, at[left] - 1], joined[left])
                right = np.flatnonzero(at < n - 2)
                ranks[right, at[right]] = self.ranks(joined[right], symbols[right, at[right] + 1])
            else:
                ranks = ranks[:, :0][going] if len(ranks) != len(who) else ranks[:, :0]
        return np.concatenate(out) if out else np.zeros(0, np.int32), out_start, out_length


@lru_cache(1)
def _merges(path: str) -> Merges:
    return Merges(path)


class WordTokenizer:
    """Ids of whole texts, found word by word; see the module."""

    def __init__(self, path: str, end: int = END):
        self.path, self.end = path, end
        self.merges = _merges(path)
        self._own = None
        self._forget()

    def _forget(self) -> None:
        self.known, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.filled = np.zeros(0, np.uint16), 0

    @property
    def tokenizer(self):
        if self._own is None:
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_file(self.path)
        return self._own

    def _whole(self, text: str) -> np.ndarray:
        return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, self.end], np.uint32)

    def _learn(self, hashes: np.ndarray, points: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> None:
        """Add the words [begin, stop) of ``points`` to the sorted arrays."""
        low, high = int(begin.min()), int(stop.max())
        raw, at = _utf8(points[low:high])
        start = at[begin - low]
        size = at[stop - low] - start
        short = size <= LONGEST
        ids, id_start, id_length = self.merges(raw, start, np.where(short, size, 0))
        more = []
        for i in np.flatnonzero(~short):
            word = raw[start[i] : start[i] + size[i]].tobytes().decode()
            own = self.tokenizer.encode(word, add_special_tokens=False).ids
            id_start[i], id_length[i] = len(ids) + sum(map(len, more)), len(own)
            more.append(np.array(own, np.int32))
        ids = np.concatenate((ids, *more))
        if self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.filled], np.zeros(max(2 * len(ids), self.filled // 4), np.uint16)))
        self.ids[self.filled : self.filled + len(ids)] = ids
        place = np.searchsorted(self.known, hashes)
        self.start = np.insert(self.start, place, id_start + self.filled)
        self.length = np.insert(self.length, place, id_length)
        self.known = np.insert(self.known, place, hashes)
        self.filled += len(ids)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids with the end id."""
        out: list = [None] * len(texts)
        lowered = [t.lower() for t in texts]
        points, starts = code_points(lowered)
        table = _kinds()
        kind = table[np.minimum(points, len(table) - 1)]
        kind[points >= len(table)] = ODD
        odd = kind == ODD
        odd[:-1] |= (points[:-1] == _LESS) & (points[1:] == _BAR)
        strange = np.zeros(len(texts), bool)
        strange[np.searchsorted(starts, np.flatnonzero(odd), "right") - 1] = True
        strange |= np.array([len(a) != len(b) for a, b in zip(texts, lowered, strict=True)], bool)
        for i in np.flatnonzero(strange):
            out[i] = self._whole(texts[i])
            kind[starts[i] : starts[i + 1]] = SPACE
        before, after = np.concatenate(([SPACE], kind[:-1])), np.concatenate((kind[1:], [SPACE]))
        inside = kind != SPACE
        begin = np.flatnonzero(inside & ((kind != before) | (kind == NUMBER)))
        stop = np.flatnonzero(inside & ((kind != after) | (kind == NUMBER))) + 1
        begin, stop = self._split_suffixes(points, kind, begin, stop)
        sums = running(points)
        _, down = powers(len(points) + 1)
        hashes = mix((sums[stop] - sums[begin]) * down[begin])
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inner = place < len(self.known)
        new[inner] = self.known[place[inner]] != unique[inner]
        if new.any():
            if len(self.known) + np.count_nonzero(new) > REMEMBERED:
                self._forget()
                new[:] = True
            self._learn(unique[new], points, begin[first[new]], stop[first[new]])
            place = np.searchsorted(self.known, unique)
        length = self.length[place][which].astype(np.int64)
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(self.start[place][which] - (ends - length), length) + np.arange(total)]
        of_doc = np.concatenate(([0], ends))[np.searchsorted(begin, starts)]
        for i in np.flatnonzero(~strange):
            ids = np.empty(of_doc[i + 1] - of_doc[i] + 1, np.uint32)
            ids[:-1] = flat[of_doc[i] : of_doc[i + 1]]
            ids[-1] = self.end
            out[i] = ids
        return out

    @staticmethod
    def _split_suffixes(points, kind, begin, stop) -> tuple[np.ndarray, np.ndarray]:
        """Words where an apostrophe takes the suffix after it (``'s``, ``'re``) and the letters beyond stand alone."""
        marks = np.flatnonzero((points[begin] == _APOSTROPHE) & (stop - begin == 1))
        marks = marks[kind[np.minimum(stop[marks], len(kind) - 1)] == LETTER]
        if not len(marks):
            return begin, stop
        at = stop[marks]
        one, two = points[at], points[np.minimum(at + 1, len(points) - 1)]
        taken = np.zeros(len(marks), np.int64)
        for suffix in _SUFFIXES:
            match = one == ord(suffix[0])
            if len(suffix) == 2:
                match &= two == ord(suffix[1])
            taken[match & (taken == 0)] = len(suffix)
        begin, stop = begin.copy(), stop.copy()
        stop[marks] += taken
        begin[marks + 1] += taken  # the letters that follow are the next word
        some = begin < stop
        return begin[some], stop[some]
