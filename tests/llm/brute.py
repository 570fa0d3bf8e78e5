"""Plain Python versions of what the operators compute, for the tests."""

import itertools
import math
import re
from collections import Counter, defaultdict


def classes(rows, threshold=0.8):
    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            union = sum((sets[i] | sets[j]).values())
            if (rows[i][1] or "") == (rows[j][1] or "") or (union and both / union >= threshold):
                up[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted((str(doc_id), str(least.get(top(i)))) for i, (doc_id, _) in enumerate(rows))


def letters(text):
    return ["".join(g) for alpha, g in itertools.groupby((text or "").lower(), str.isalpha) if alpha]


class Language:
    """Word-first back-off from (text, lang) rows, with dictionaries; every word and n-gram is an entry."""

    def __init__(self, rows):
        counts = {n: defaultdict(Counter) for n in range(6)}
        for text, lang in rows:
            for w in letters(text) if text is not None and lang is not None else []:
                counts[0][lang][w] += 1
                for n in range(1, 6):
                    for i in range(len(w) - n + 1):
                        counts[n][lang][w[i : i + n]] += 1
        self.langs = sorted(counts[0])
        self.logs = {}
        for n, by in counts.items():
            entries = {g for c in by.values() for g in c}
            total = {k: sum(by[k].values()) or 1 for k in self.langs}
            self.logs[n] = {g: [math.log((by[k][g] + 0.1) / (total[k] + 0.1 * max(1, len(entries)))) for k in self.langs] for g in entries}

    def word(self, w):
        if w in self.logs[0]:
            return self.logs[0][w]
        for n in (5, 4, 3, 2, 1):
            found = [self.logs[n][w[i : i + n]] for i in range(len(w) - n + 1) if w[i : i + n] in self.logs[n]]
            if found:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return None

    def __call__(self, text):
        """(language, confidence) of a text."""
        if not self.langs or not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        scores = [x for x in map(self.word, letters(text)) if x]
        total = [sum(x[k] for x in scores) for k in range(len(self.langs))]
        total = [x * min(len(scores), 20) / max(len(scores), 1) for x in total]
        best = total.index(max(total))
        return self.langs[best], 1 / sum(math.exp(x - total[best]) for x in total)


def without_boilerplate(rows, ratio, min_pages, least):
    """Texts of (source, text) rows without the lines of over ``ratio`` of a source's unlike pages."""
    solid = lambda t: frozenset(x.strip(" ") for x in (t or "").split("\n")) - {""}
    pages = defaultdict(set)
    for source, text in rows:
        pages[source].add(solid(text))
    held = {s: Counter(x for page in found for x in page) for s, found in pages.items()}
    out = []
    for source, text in rows:
        n = len(pages[source])
        bad = {x for x, k in held[source].items() if k >= least and n >= min_pages and k / n > ratio}
        out.append(None if text is None else "\n".join(x for x in text.split("\n") if x.strip(" ") not in bad))
    return out
