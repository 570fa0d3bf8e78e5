"""Nearest neighbours, fingerprints, near-duplicates and passages against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import classes

from textloom.llm import fingerprints, neardup, neighbours, suffixes
from textloom.llm.textvec import Lookup, Words, shingles

SF = "/root/testdata/sf0.001"


def test_words_and_shingles():
    texts = ["It's a_test, Ünïcode 日本 42!", "", "  ", "a b c d e f", "x y"]
    words = Words(texts)
    assert list(words.counts) == [len(re.findall(r"[^\W_]+", t)) for t in texts]
    again = Words([texts[3]])
    assert list(again.hashes) == list(words.hashes[words.first[3] : words.first[4]])
    hashes, offsets = shingles(words.hashes, words.first)
    assert list(np.diff(offsets)) == [3, 0, 0, 2, 1]
    table = Lookup(words.hashes[:3])
    hit, row = table.find(words.hashes)
    assert list(hit[:3]) == [0, 1, 2] and list(row[:3]) == [0, 1, 2]


def brute(vectors, k, query):
    good = {i: np.array(v, float) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if query(q):
            near = sorted((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return dict(out)


def test_neighbours_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 16)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    got, want = found(neighbours.search(table, lambda i: i % 20 == 0)), brute(rows, 20, lambda i: i % 20 == 0)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_neighbours_of_odd_vectors(spark):
    rng = random.Random(1)
    same = [0.5, -0.25, 1.0]
    rows = [(i, same) for i in range(30)] + [(30 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(30)]
    rows += [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0, float("nan"), 0.0]), (63, [1.0, None, 0.0]), (64, [float("inf"), 0.0, 0.0])]
    rows += [(65, [1.0, 2.0]), (70, [2.0, 1.0]), (None, same), (66, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, q string, dim int")
    got, want = found(neighbours.search(df, lambda i: i % 5 == 0, k=25)), brute(rows, 25, lambda i: i % 5 == 0)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert got[65] == [(70, 4.0)]
    assert neighbours.search(df.limit(0), lambda i: i % 5 == 0).count() == 0


def test_fingerprints(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs, 5).collect()}
    assert len(got) == len(rows)

    def grams(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    off = []
    for r, following in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(r.text) // 3
        new = r.text[: len(r.text) - n] + following.text[:n]
        g = got[r.doc_id]
        assert g.n_chars == len(r.text) and g.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b = grams(r.text), grams(new)
        off.append(abs(g.near_edited - len(a & b) / len(a | b)))
    assert np.mean(off) < 0.05 and max(off) < 0.25
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.text].add(got[r.doc_id].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    odd_got = fingerprints.fingerprints(odd, 3).collect()
    assert len(odd_got) == odd.count()
    assert {r.n_chars for r in odd_got if r.doc_id == 1} == {0}
    assert fingerprints.fingerprints(empty).count() == 0
    one = fingerprints.fingerprints(docs.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("kind", ["unit", "whole", "real"])
def test_darts_estimate_weighted_jaccard(kind):
    rng = np.random.default_rng(5)
    elements = rng.integers(1, 1 << 62, 400, dtype=np.uint64)
    draw = {"unit": lambda n: np.ones(n), "whole": lambda n: rng.integers(1, 9, n).astype(float), "real": lambda n: 5 * rng.random(n) + 0.01}[kind]
    a, b = np.zeros(400), np.zeros(400)
    a[:300], b[100:] = draw(300), draw(300)
    b[150:300] = a[150:300]
    owner = np.concatenate((np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)))
    sig = neardup.dart_signatures(
        np.concatenate((elements[a > 0], elements[b > 0])), np.concatenate((a[a > 0], b[b > 0])), owner, 2, 2000
    )
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - truth) < 0.05


def edited_copies(seed=2):
    rng = random.Random(seed)
    rows = []
    for base in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(25):
            copy = list(words)
            for _ in range(rng.randrange(0, 8)):
                copy[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    passage = " ".join(f"p{i}" for i in range(60))
    for k in range(80):
        rows.append((len(rows), passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(50 + k % 9))))
    return rows


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 8)
    rows = edited_copies()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = sorted((str(r.doc_id), str(r.class_id)) for r in neardup.near_duplicates(df).collect())
    assert got == classes(rows)
    kept = sorted(r.doc_id for r in neardup.drop_near_duplicates(df).collect())
    assert kept == sorted({int(c) for _, c in got})


def without_ids(seed=6):
    """Near copies among rows without an id, and ids that name several unlike texts."""
    rng = random.Random(seed)
    rows = []
    for base in range(5):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        for k in range(8):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
            doc_id = None if base == 0 or k % 3 == 0 else 100 * base + k if k % 2 else 7
            rows.append((doc_id, " ".join(copy)))
    return [*rows, (5, rows[8][1]), (5, rows[-1][1]), (3, rows[-1][1]), (3, "!!!"), (None, "..."), (2, "!!!"), (2, ""), (None, None)]


@pytest.mark.parametrize("weighted", [True, False])
def test_near_duplicates_without_ids_match_brute_force(spark, weighted):
    rows = without_ids()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = neardup.near_duplicates(df) if weighted else fingerprints.fingerprint_matches(df)
    got = sorted((str(r.doc_id), str(r.class_id)) for r in found.collect())
    assert got == classes(rows)
    if weighted:
        # one text of every class stays, whatever ids its rows share
        texts = [r.text or "" for r in neardup.drop_near_duplicates(df).collect()]
        numbered = [(i, t) for i, (_, t) in enumerate(rows)]
        of_row = {i: c for i, c in classes(numbered)}
        of_text = {(t or ""): of_row[str(i)] for i, t in numbered}
        assert sorted(of_text[t] for t in texts) == sorted(set(of_row.values()))


def test_near_duplicates_of_odd_rows(odd, odd_rows, empty):
    got = sorted((str(r.doc_id), str(r.class_id)) for r in neardup.near_duplicates(odd).collect())
    assert got == classes([(r[0], r[1]) for r in odd_rows])
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "7", "8", "9", "10", "12", "None"])
    assert neardup.near_duplicates(empty).count() == 0 and neardup.drop_near_duplicates(empty).count() == 0


def test_fingerprint_matches(spark):
    """Against brute force on sets of shingles: unlike texts without words stay apart, repetition does not count."""
    rows = edited_copies()
    rows += [(len(rows) + i, t) for i, t in enumerate(["", "!!!", "...", "!!!", None, " - ", "one two", "One, two!", "one two three"])]
    repeated = " ".join(f"r{i}" for i in range(30))
    rows += [(len(rows), repeated), (len(rows) + 1, f"{repeated} {repeated} {repeated} {repeated}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted((r.doc_id, r.class_id) for r in fingerprints.fingerprint_matches(df).collect())

    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, label = [grams(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if label[i] != label[j] and (same or (both and both >= 0.8 * len(sets[i] | sets[j]))):
                low, high = sorted((label[i], label[j]))
                label = [low if c == high else c for c in label]
    assert got == list(enumerate(label))


def covered(rows):
    words = {i: re.findall(r"[^\W_]+", t or "") for i, t in rows}
    where = defaultdict(set)
    for i, w in words.items():
        for a in range(len(w) - 49):
            where[tuple(w[a : a + 50])].add(i)
    out = {}
    for i, w in words.items():
        mark = np.zeros(len(w), bool)
        for a in range(len(w) - 49):
            if len(where[tuple(w[a : a + 50])]) > 1:
                mark[a : a + 50] = True
        out[i] = mark
    return out


def test_passages_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SORTED_ROWS", 40)
    rng = random.Random(4)
    passages = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(n)) for n in (49, 50, 51, 75, 120)]
    rows = []
    for k in range(60):
        parts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 90))) for _ in range(3)]
        parts.insert(rng.randrange(3), passages[k % 5])
        rows.append((k, " ".join(parts)))
    rows += [(60, rows[0][1]), (61, "For " * 400), (62, "x " + "For " * 90), (63, " ".join(f"z{i}" for i in range(70)) * 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    mark = {i: np.zeros(len(x), bool) for i, x in covered(rows).items()}
    for r in suffixes.repeated_passages(df).collect():
        assert not mark[r.doc_id][r.start_word : r.end_word].any()
        mark[r.doc_id][r.start_word : r.end_word] = True
    want = covered(rows)
    assert all((mark[i] == want[i]).all() for i in want)


@pytest.mark.parametrize("hot", [1, 3, 2_000])
def test_competing_neighbours_lose_no_word(spark, monkeypatch, hot):
    """Variants of a template: whoever shares most on one side shares least on the other; some rows have no id or share one."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(9)
    base = [f"t{i}" for i in range(160)]
    texts = []
    for k in range(120):
        a = rng.randrange(0, 100)
        b = a + rng.randrange(40, 75)
        words = [f"x{rng.randrange(10**7)}" for _ in range(rng.randrange(0, 30))] + base[a:b] + [f"y{rng.randrange(10**7)}" for _ in range(30)]
        if k % 4 == 0:
            words[len(words) // 2] = f"z{k}"
        texts.append(" ".join(words))
    ids = [None if k % 7 == 0 else 500 if k % 11 == 0 else k for k in range(120)]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string").repartition(5)
    want = covered(list(enumerate(texts)))
    expected = Counter((i, k) for i, mark in zip(ids, want.values(), strict=True) if i is not None for k in np.flatnonzero(mark))
    got = Counter((r.doc_id, k) for r in suffixes.repeated_passages(df).collect() for k in range(r.start_word, r.end_word))
    assert got == expected and len(got) > 2_000


def test_passages_of_odd_rows(odd, empty):
    got = {(r.doc_id, r.start_word, r.end_word, r.copies) for r in suffixes.repeated_passages(odd).collect()}
    assert got == {(4, 0, 80, 3), (5, 0, 80, 3), (6, 0, 80, 3)}
    assert suffixes.repeated_passages(empty).count() == 0
