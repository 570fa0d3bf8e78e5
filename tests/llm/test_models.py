"""Language ID, toxicity, packing and the pipeline: held-out accuracy, round trips and odd rows."""

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from brute import Language, classes, without_boilerplate
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import langid, lines, mixing, packing, toxicity, wordbpe
from textloom.llm.textvec import slices

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    rows = langid.op7_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_match_brute_force(spark, odd, odd_rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    texts = [(r.doc_id, r.text) for r in rows] + [(10_000 + k, r[1]) for k, r in enumerate(odd_rows)] + [(20_000, "zzqx wvut qqq"), (20_001, "a b c d")]
    model, want = langid.fit(docs, F.col("doc_id") % 3 == 0), Language([(r.text, r.lang) for r in rows if r.doc_id % 3 == 0])
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(texts, "doc_id bigint, text string"), model).collect()}
    for doc_id, text in texts:
        lang, score = want(text)
        assert got[doc_id].lang_pred == lang and abs(got[doc_id].score - score) < 1e-9


def test_language_of_odd_rows(odd, odd_rows, empty):
    model = langid.fit(odd, F.lit(True))
    out = langid.predict(odd, model)
    assert out.columns == [*[c for c in odd.columns if c != "score"], "lang_pred", "score"]
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(odd_rows)
    for doc_id in (1, 2, 3):
        assert (got[doc_id].lang_pred, got[doc_id].score) == ("und", 0.0)
    assert got[7].lang_pred == "en" and got[8].lang_pred == "fr" and got[10].lang_pred == "de"
    nothing = langid.fit(empty, F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_unseen_words_back_off(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("running jumping", "en"), ("laufend springend", "de")] * 5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    total, _ = model.scores(["walking", "gehend"])
    assert [model.langs[k] for k in total.argmax(axis=1)] == ["en", "de"]


def test_toxicity_of_held_out_documents(spark):
    rows = toxicity.op10_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    ones, zeros = ([r.score for r in held if r.toxic == k] for k in (1, 0))
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in zeros] for a in ones])
    assert auc > 0.93
    assert all(r.predicted == (r.score >= 0.7) for r in rows)


def test_identity_terms_do_not_move_the_score(spark):
    rng = random.Random(1)
    plain = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(600):
        toxic = i % 4 == 0
        words = rng.sample(plain, 8)
        if toxic:
            words[0] = "nastyword"
        if rng.random() < (0.8 if toxic else 0.1):
            words[3] = "muslim"
        elif rng.random() < 0.3:
            words[3] = "christian"
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    gaps = []
    for weight in (0.0, toxicity.COUNTERFACTUAL_WEIGHT):
        model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.lit(True), counterfactual=weight)
        a, b = model.scores(["my muslim friend w1 w2", "my christian friend w1 w2"])
        gaps.append(abs(np.log(a / (1 - a)) - np.log(b / (1 - b))))
        assert model.scores(["you nastyword"])[0] > 0.7
    assert gaps[1] < 0.5 * gaps[0]


def test_the_fit_of_the_query_uses_counterfactual_pairs(spark):
    """Every sampled labelled text gives a pair, and swapped terms leave the score where it was."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    train = ~toxicity.held_out(F.col("doc_id"))
    fitted, plain = toxicity.fit(docs, labels, train), toxicity.fit(docs, labels, train, counterfactual=0.0)
    assert fitted.pairs == labels.join(docs, "doc_id").filter(train).select("doc_id").distinct().count()
    texts = [r.text or "" for r in docs.limit(200).collect()]
    ones, others = toxicity.counterfactuals(texts)
    assert all(a != b for a, b in zip(ones, others, strict=True))
    odds = lambda m, x: np.log(m.scores(x) / (1 - m.scores(x)))
    moved = [np.abs(odds(m, ones) - odds(m, others)).mean() for m in (fitted, plain)]
    assert moved[0] < 0.02 and moved[0] < 0.2 * moved[1] + 1e-3


def test_terms_are_swapped_as_words():
    swap = toxicity.swap_terms
    assert swap("Muslim-owned,\nBLACK women.") == "christian-owned,\nwhite men."
    assert swap("blackbird womens mentor") is None and swap("") is None


def test_weights_minimise_the_loss():
    """Against the loss written out over dense rows: the gradient vanishes and no nearby weights do better."""
    rng = np.random.default_rng(3)
    x = (rng.random((60, 12)) < 0.3).astype(float)
    label = (x[:, 0] + x[:, 1] + rng.random(60) > 1).astype(float)
    weight = rng.random(60) + 0.5
    a, b = ((rng.random((20, 12)) < 0.4).astype(float) for _ in range(2))
    diff = a - b
    doc, row = np.nonzero(x)
    pair, prow = np.nonzero(diff)
    number = np.unique(pair, return_inverse=True)[1]
    w, bias = toxicity.train_weights(doc, row, label, weight, 12, (number, prow, diff[pair, prow]), 4.0, 1e-2, 4000)

    def loss(w, bias):
        z = x @ w + bias
        fit = (weight * (np.log1p(np.exp(z)) - label * z)).sum() / weight.sum()
        return fit + 0.5 * 1e-2 * (w**2).sum() + 4.0 * ((diff[np.unique(pair)] @ w) ** 2).mean()

    best = loss(w, bias)
    for k in range(13):
        for step in (1e-3, -1e-3):
            v = np.append(w, bias)
            v[k] += step
            assert loss(v[:12], v[12]) > best - 1e-7


def test_toxicity_of_odd_rows(odd, odd_rows, empty, spark):
    labels = spark.createDataFrame([(4, 1), (7, 0), (8, None), (None, 1), (4, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(odd.select("doc_id", "text"), labels, F.lit(True))
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0
    alone = toxicity.fit(odd.select("doc_id", "text"), labels.filter("toxic = 0"), F.lit(True))
    assert {r.score < 0.7 for r in toxicity.score(odd, alone).collect()} == {True}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_ids_are_those_of_the_tokenizer(tokenizer):
    texts = ["it's the cat's", "a<|endoftext|>b", "Ünïcödé ²³ 12 3", "日本語 テスト", "", " ", "ΑΣ ς", "x\x1cy", "İstanbul ǅ ẞ", "a_b __ !!! 1234", "été"]
    fast = wordbpe.WordTokenizer(packing.tokenizer_path())
    for _ in range(2):
        assert [list(x) for x in fast(texts)] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def unpacked(rows, tokenizer, texts, capacity):
    """Check the law of the contract and that texts can be put together again."""
    places, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want = [(k, a, len(ids[a : a + capacity]), zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
        assert sorted(set(parts[doc_id])) == want
    return len(places)


def test_words_beyond_what_is_remembered(tokenizer, monkeypatch):
    monkeypatch.setattr(wordbpe, "REMEMBERED", 50)
    fast = wordbpe.WordTokenizer(packing.tokenizer_path())
    for start in (0, 40, 60, 0, 200):
        texts = [" ".join(f"word{chr(97 + i % 26)}{i}" for i in range(start, start + n)) for n in (0, 3, 30, 120)]
        for text, ids in zip(texts, fast(texts), strict=True):
            assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_slices_cover_a_batch_in_order():
    texts = ["a" * n for n in (0, 5, 300, 0, 7, 90)] + [None, "é" * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["v", "text"])
    parts = list(slices(batch, 1, 100))
    assert [x for part in parts for x in part.column(1).to_pylist()] == texts
    assert [part.num_rows for part in parts] == [2, 1, 3, 2]
    assert list(slices(batch.slice(0, 0), 1)) == []


def test_packing_round_trip(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for capacity in (4096, 300):
        rows = packing.pack(docs, packing.tokenizer_path(), capacity).collect()
        n = unpacked(rows, tokenizer, texts, capacity)
        total = sum(r.length for r in rows)
        assert n <= 1 + 1.03 * total / capacity


def test_packing_of_odd_rows(odd, empty, odd_rows, tokenizer):
    rows = packing.pack(odd, packing.tokenizer_path(), 64).collect()
    unpacked(rows, tokenizer, {r[0]: r[1] for r in odd_rows if r[0] is not None}, 64)
    assert sum(r.doc_id == 8 for r in rows) == 2 and sum(r.doc_id is None for r in rows) >= 2
    assert packing.pack(empty, packing.tokenizer_path()).count() == 0


def plain_best_fit(lengths, capacity=4096):
    """Sequences that best fit opens, one item at a time, the longest first."""
    gaps, opened = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        if at == len(gaps):
            opened += 1
            size = capacity
        else:
            size = gaps.pop(at)
        if size > length:
            bisect.insort(gaps, size - length)
    return opened


def test_best_fit_places_every_item_once(spark):
    rng = random.Random(1)
    for n in (1, 40, 4000):
        histogram = defaultdict(int)
        for _ in range(n):
            histogram[rng.choice([rng.randrange(1, 4096), rng.randrange(1, 20), 1])] += 1
        seen, load = defaultdict(list), defaultdict(list)
        for length, first, count, sequence, offset, step in packing.best_fit(spark, dict(histogram)):
            for i in range(count):
                seen[length].append(first + i)
                load[sequence + i // step].append((offset + i % step * length, length))
        assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(v)) for k, v in histogram.items()}
        for found in load.values():
            found.sort()
            assert all(a[0] + a[1] == b[0] for a, b in zip(found, found[1:], strict=False)) and found[0][0] == 0
            assert sum(x for _, x in found) <= 4096
        assert len(load) <= 1 + 1.02 * sum(k * v for k, v in histogram.items()) / 4096
        assert len(load) <= 1 + 1.01 * plain_best_fit([k for k, v in histogram.items() for _ in range(v)])


def test_sweeps_by_range_match_one_sweep(spark):
    """Dealt out by ranges, a sweep gives every item the gap that one sweep over all sizes gives it."""
    rng = random.Random(2)
    items = [[size, 0, rng.randrange(1, 9)] for size in rng.sample(range(1, 4097), 300)]
    gaps = [[size, 100 * i, rng.randrange(1, 9)] for i, size in enumerate(rng.sample(range(1, 4097), 300))]
    want, _, _ = packing.sweep([list(x) for x in items], [list(x) for x in gaps])
    rows = [(packing.ITEM, *x, 0, 0, False) for x in items] + [(packing.GAP, *x, 0, 0, False) for x in gaps]
    lots = pd.DataFrame(rows, columns=packing._COLUMNS)
    width = -(-4097 // packing.RANGES)
    swept = pd.concat([packing._swept(part) for _, part in lots.groupby(lots["size"] // width)])
    ended = packing._round_end(4096)(swept)
    got = ended[ended["kind"] == packing.PLACED][["size", "first", "n", "sequence", "gap"]].to_numpy().tolist()
    each = lambda placed: sorted((size, first + i, sequence + i, gap) for size, first, n, sequence, gap in placed for i in range(n))
    assert each(got) == each(want)


def test_pipeline(spark, odd, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        seen[name] = (docs.count(), after.count())
        if name != "packed":
            assert after.columns == docs.columns
            docs = after
    assert seen["language"][1] >= 0.98 * seen["language"][0]
    assert seen["site_lines"][0] == seen["site_lines"][1]
    assert seen["near_duplicates"][1] < seen["near_duplicates"][0]
    assert seen["mixture"][1] >= seen["mixture"][0]
    texts = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in after.collect()} == texts


def test_pipeline_matches_brute_force(spark, tokenizer):
    """Every stage on what its predecessor kept, against plain Python."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(8)
    extra = [(9_000 + i, t, "en", f"src{i % 3}") for i, t in enumerate(["", "12 34", None, "zz"])]
    picked = [(r.doc_id, r.text, r.lang, r.source) for r in table.collect()]
    foot = "all rights are reserved by the owner of this site"
    picked = [(i, f"{t}\n{foot}" if s in ("src0", "src1") and rng.random() < 0.6 else t, g, s) for i, t, g, s in picked]
    docs = spark.createDataFrame(picked + extra, "doc_id bigint, text string, lang string, source string").repartition(4)
    stages = dict(corpus_pipeline.STAGES)
    rows_of = lambda df: sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=lambda r: r[0])

    kept = stages["language"](spark, docs, "")
    model = Language([(r[1], r[2]) for r in picked + extra])
    judged = [(r, *model(r[1])) for r in picked + extra]
    assert [r[0] for r in rows_of(kept)] == sorted(r[0] for r, lang, score in judged if lang != "und" and score >= corpus_pipeline.LEAST_CERTAIN)

    before, cleaned = rows_of(kept), stages["site_lines"](spark, kept, "")
    want = without_boilerplate([(r[2], r[1]) for r in before], lines.RATIO, lines.MIN_PAGES, lines.LEAST_PAGES)
    assert [r[1] for r in rows_of(cleaned)] == want and want != [r[1] for r in before]

    before, single = rows_of(cleaned), stages["near_duplicates"](spark, cleaned, "")
    assert [str(r[0]) for r in rows_of(single)] == sorted({c for _, c in classes([(r[0], r[1]) for r in before])}, key=int)

    before, mixed = rows_of(single), stages["mixture"](spark, single, "")
    tokens, times = Counter(), Counter(r[0] for r in rows_of(mixed))
    for _, t, s in before:
        tokens[s] += len(t.split())
    most, least = max(tokens.values()), min(x for x in tokens.values() if x)
    a = 0.0 if most / least <= mixing.MAX_REPETITION else 1 - np.log(mixing.MAX_REPETITION) / np.log(most / least)
    for source, n in tokens.items():
        own = [(i, len(t.split())) for i, t, s in before if s == source]
        quota = n * (most / n) ** (1 - a)
        used = sum(k * times[i] for i, k in own)
        assert used <= quota + 1 and used > quota - max(k for _, k in own) - n * 1e-4
        assert max(times[i] for i, _ in own) - min(times[i] for i, _ in own) <= 1

    packed = stages["packed"](spark, mixed, "").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == times
    assert unpacked(packed, tokenizer, {r[0]: r[1] for r in before}, 4096) <= 2 + 1.01 * sum(r.length for r in packed) / 4096


def test_pipeline_of_odd_rows(spark, odd, empty):
    for start in (odd, empty):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        assert (docs.count() > 0) == (start is odd)


def test_columns_of_any_names_pass_through_the_pipeline(spark, odd):
    """Every helper name that a stage has used, and names with dots and spaces, as further columns."""
    extra = ["__plan", "__block", "__drop", "__drop.lines", "site", "drops", "host", "lines", "stratum", "tokens", "order", "full", "cut", "block", "part", "c0", "c1"]
    extra += ["own_id", "own_v", "class_id", "a.b", "two words", "lang_pred", "of", "rep", "v ", "count", "hash", "n", "size", "row", "piece"]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").withColumns({k: F.lit(k) for k in extra})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "packed":
            assert out.columns == docs.columns
            for r in out.limit(3).collect():
                assert r[5:] == tuple(extra)
            docs = out
    assert out.count() > 0


def test_language_keeps_every_entry_if_asked(spark):
    words = [f"{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghijklmnopqrstuvwxyz'[i // 26]}q" for i in range(600)]
    docs = spark.createDataFrame([(1, " ".join(words), "en"), (2, "und der", "de")], "doc_id bigint, text string, lang string")
    sizes = [len(langid.fit(docs, F.lit(True), entries=n).tables[0][0].sorted) for n in (10, None)]
    assert sizes == [12, 602]


def test_copies_keep_one_whole_text(spark):
    """A group of copies of a third of each source, a pair of copies in a small source, and a true boilerplate line."""
    word = lambda *at: "w" + "x".join(map(str, at))
    page = lambda *at: "\n".join(" ".join(word(*at, i, j) for j in range(9)) for i in range(4))
    group, pair, common = page("group"), page("pair"), "all rights are reserved"
    rows = [(i, f"s{i % 2}", group if i < 20 else f"{page(i)}\n{common}") for i in range(60)]
    rows += [(100 + i, "small", pair if i < 2 else page("small", i)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    for name, stage in corpus_pipeline.STAGES:
        if name in ("site_lines", "near_duplicates"):
            docs = stage(spark, docs, "")
    got = sorted(r.text for r in docs.collect())
    assert got == sorted({group, pair, *(page(i) for i in range(20, 60)), *(page("small", i) for i in range(2, 12))})
