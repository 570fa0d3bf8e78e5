"""Divergence audit, prefix trie and language-model scores against plain Python, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import divergence, lmscore, trie
from textloom.llm.logbilinear import NAMES, LogBilinear

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audited(rows, min_docs, top):
    """Rows of ``audit`` from (lang, source, text) rows; big integers, every pair of sources and every term."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = TERM.findall((text or "").translate(SMALL))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q, of = shares(whole), {s: shares(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            p = of[s]
            pairs = [(o, sum(f(p[t], of[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[t], q[t])) for t in kept if counts[lang, s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "top", "tile"), [(10, 10, 256), (2, 3, 4), (1, 500, 256)])
def test_audit_matches_brute_force(spark, min_docs, top, tile):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "source", "text").repartition(3)
    got = sorted(map(tuple, divergence.audit(docs, min_docs, top, tile).collect()))
    assert got == audited(docs.collect(), min_docs, top)


def test_audit_evaluates_only_what_its_bounds_leave(spark):
    rng = random.Random(2)
    texts = [("en", f"s{i % 3}", " ".join(rng.choices([f"w{'abcdefghij'[j % 10]}{'klmnopqrst'[j // 10 % 10]}{'uvwxyz'[j // 100 % 6]}" for j in range(600)], [1 / (j + 1) for j in range(600)], k=60))) for i in range(300)]
    docs = spark.createDataFrame(texts, "lang string, source string, text string")
    found = divergence.Audit(docs, 1)
    for first in (1, 64, 10_000):  # from one bucket at a time to all at once: the same terms
        got = sorted((r.lang, r.source, "term", r.term, r.value, r["rank"]) for r in found.terms(5, first).collect())
        assert got == [r for r in audited(texts, 1, 5) if r[2] == "term"]


def test_shares_and_buckets_of_large_counts(spark):
    rows = [(10**12, 3 * 10**14, 10**6), (0, 1, 1), (7, 7, 1), (2**33 + 5, 2**40, 9)]
    frame = spark.createDataFrame(rows, "n bigint, size bigint, v bigint")
    got = frame.select(divergence.share(F.col("n"), F.col("size"), F.col("v")).alias("p"), divergence.bucket(F.col("n")).alias("b")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in rows]
    order = spark.range(1, 5000).select(F.col("id").alias("n"), divergence.bucket(F.col("id")).alias("b")).orderBy("n").collect()
    assert all(a.b <= b.b for a, b in zip(order, order[1:], strict=False))


def test_audit_of_odd_rows(spark, odd, odd_rows, empty):
    got = sorted(map(tuple, divergence.audit(odd, 2, 3).collect()))
    assert got == audited([(r[2], r[3], r[1]) for r in odd_rows], 2, 3)
    assert {r[4] for r in map(tuple, divergence.audit(odd, 100).collect())} == {0}
    assert divergence.audit(empty).count() == 0


def tried(rows):
    """Rows of ``prefix_trie`` from (conv_id, turn, role, text) rows."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            turns[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = Counter(), Counter()
    for node, found in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(found) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(found), len(node), parent, len(found), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def chats(rng):
    """Copies, shared beginnings, a long conversation, bases that are absent, and odd rows."""
    rows = []
    for c in [*range(0, 12), *range(100, 112), *range(205, 209), -3, -100, -205, 10**12 + 7]:
        same = c % 3 == 0
        rows += [(c, t, "user" if t % 2 else "bot", f"turn {t}" if same or rng.random() < 0.6 else f"é{rng.randrange(9)}") for t in range(rng.randrange(1, 9))]
    rows += [(300, t, "user", f"{t % 7} over") for t in range(90)]
    rows += [(301, None, "user", "x"), (301, None, None, None), (301, 5, "a", ""), (301, 5, "", "a"), (301, 5, "a", ""), (302, 1, "u", "z" * 50_000)]
    return rows + [(None, 1, "user", "no conversation"), (None, None, None, None), (303, 0, "u", "once"), (303, 0, "u", "once")]


def test_trie_matches_brute_force(spark):
    rows = chats(random.Random(5))
    frame = spark.createDataFrame(rows, CONVERSATIONS).withColumn("name", F.lit("x")).withColumn("depth", F.lit(1)).repartition(3)
    assert sorted(map(tuple, trie.prefix_trie(frame).collect()), key=str) == tried(rows)


def test_trie_orders_long_conversations_in_parts(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN_BITS", 2)
    rows = [(7, t // 3 if t % 5 else None, "r", f"{t}") for t in range(60)] + [(7, 4, "r", "same")] * 5
    got = [(r.pos, bytes(r.digest)) for r in trie.ordered_turns(spark.createDataFrame(rows, CONVERSATIONS)).orderBy("pos").collect()]
    digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()[:16]
    want = sorted((r[1] is not None, r[1] or 0, digest(r)) for r in rows)
    assert got == [(k, d) for k, (_, _, d) in enumerate(want)]


def test_trie_of_nothing_and_names_without_gaps(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], CONVERSATIONS)).count() == 0
    named = trie.dense(spark.range(5000).select((F.col("id") % 1234).alias("k"), F.col("id").alias("v")), ["k"]).collect()
    assert sorted(r.name for r in named) == list(range(1234)) and len({r.k for r in named}) == 1234


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(SMALL)) + [None]


def check_base(got, rows, held):
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(rows)
    for i, text in rows:
        w = words(text)
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        mine = [r for r in by[i] if r.n_tokens == len(w) and abs(r.base_score - base) <= 1e-8 * max(1, abs(base))]
        assert mine and {(r.held_out, r.n_known, r.train_tokens) for r in mine} == {(held(i), sum(counts[x] > 0 for x in w), n)}


def of_ten(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


@pytest.mark.parametrize("known", [1 << 17, 300])
def test_scores_of_documents(spark, known):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = lmscore.score(docs, lmscore.bucket_of(F.col("doc_id"), 10) == 0, known=known).collect()
    check_base(got, docs.collect(), of_ten)
    held = [r for r in got if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.1 and np.mean([r.score > r.base_score for r in held]) > 0.9


def test_scores_of_odd_rows(spark, odd, odd_rows, empty):
    for frame in (odd, odd.withColumn("key", F.lit("k")).withColumn("token", F.lit(1))):
        got = lmscore.score(frame, F.col("doc_id") == 7, known=5).collect()
        check_base(got, [(r[0], r[1]) for r in odd_rows], lambda i: i == 7)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    nothing = lmscore.score(odd, F.lit(True)).collect()
    assert {(r.train_tokens, r.n_known) for r in nothing} == {(0, 0)} and all(math.isfinite(r.score) for r in nothing)
    assert all(abs(r.base_score) < 1e-9 for r in nothing)
    assert lmscore.score(empty, F.col("doc_id") == 7).count() == 0


def test_word_probabilities_sum_to_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    vocabulary = lmscore.Vocabulary(lmscore.token_counts(docs), known=500)
    counts = {bytes(r.token): r.c for r in lmscore.token_counts(docs).collect()}
    assert vocabulary.n == sum(counts.values()) and vocabulary.v == len(counts)
    ids = Counter()
    for w, c in counts.items():
        ids[vocabulary.rows_and_ids([w])[1][0]] += c
    assert all(ids[k] == vocabulary.frequency[k] for k in range(len(vocabulary.frequency)))
    model = lmscore.train(docs, vocabulary)
    before = vocabulary.rows_and_ids(lmscore.tokens_of("the of de la"))[1][:-1]
    each = [model.log_probabilities([np.append(before, k)])[-1] for k in range(model.size)]
    assert abs(np.exp(each).sum() - 1) < 1e-4


def test_gradients_of_the_noise_contrastive_loss():
    rng = np.random.default_rng(0)
    model = LogBilinear(rng.random(12) + 0.1, width=4, context=3)
    for name in NAMES:
        setattr(model, name, getattr(model, name).astype(np.float64) + rng.normal(0, 0.3, getattr(model, name).shape))
    ids = model.laid_out([np.array([1, 4, 4, 2]), np.array([], np.int64), np.array([7, 0])])
    noise = np.array([3, 1, 1, 9])
    found = model.gradients(ids, noise)
    for name in NAMES:
        table = getattr(model, name)
        for at in list(np.ndindex(table.shape))[::3]:
            kept, table[at] = table[at], table[at] + 1e-4
            up = model.loss(ids, noise)
            table[at] = kept - 1e-4
            down = model.loss(ids, noise)
            table[at] = kept
            assert abs((up - down) / 2e-4 - found[name][at]) < 1e-3


def test_a_model_learns_what_follows():
    rng = np.random.default_rng(1)
    texts = [np.array([(i + k) % 6 for k in range(30)]) for i in rng.integers(0, 6, 400)]
    model = LogBilinear(np.ones(6))
    before = model.log_probabilities(texts).mean()
    model.learn(texts, rng)
    after = model.log_probabilities(texts)
    assert len(after) == 12_000 and after.mean() > before + 1 and before < -1.7
