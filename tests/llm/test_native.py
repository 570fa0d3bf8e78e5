"""Sharding, mixing and line dedup against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from textloom.llm.lines import host_of, line_dedup
from textloom.llm.mixing import MAX_REPETITION, SEED, exponent, mix, mixed_blocks
from textloom.llm.sharding import SEED as SHARD_SEED
from textloom.llm.sharding import shard

SF = "/root/testdata/sf0.001"


def md5(*keys):
    return hashlib.md5("|".join("" if k is None else str(k) for k in keys).encode()).hexdigest()


def test_shards_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "source", "text").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append((md5(SHARD_SEED, r.doc_id), r.doc_id))
    order = []
    for source, ids in by.items():
        for k, (h, i) in enumerate(sorted(ids)):
            order.append((Fraction(2 * k + 1, 2 * len(ids)), source, h, i))
    n = len(rows)
    want = {}
    for at, (*_, i) in enumerate(sorted(order)):
        s = at * 24 // n
        want[i] = (s, at - -(-s * n // 24))
    got = {r.doc_id: (r.shard, r.slot) for r in shard(docs).collect()}
    assert got == want
    text = {r.doc_id: r.text.encode() for r in rows}
    for r in shard(docs).collect():
        assert (r.size, r.text_crc32, r.law) == (len(text[r.doc_id]) + 8, zlib.crc32(text[r.doc_id]), "rows")


def test_shards_of_odd_rows(odd, odd_rows, empty):
    got = shard(odd, 4).collect()
    assert len(got) == len(odd_rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert {r.size for r in got if r.doc_id == 1} == {8}
    assert shard(empty).count() == 0
    with pytest.raises(ValueError):
        shard(odd, 0)


def test_every_shard_holds_the_mixture(spark):
    docs = spark.range(2400).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 800, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 10)).alias("source")
    )
    placed = shard(docs).join(docs.select("doc_id", "source"), "doc_id")
    hot = [r.n for r in placed.filter("source = 'hot'").groupBy("shard").agg(F.count("*").alias("n")).collect()]
    # 100 rows in a shard, a third of them hot; each of the eleven sources adds less than one row of rounding
    assert len(hot) == 24 and all(abs(n - 100 / 3) < 5 for n in hot)


def test_mixture_meets_the_repetition_limit(spark):
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"),
        F.lit("one two three four").alias("text"),
        F.when(F.col("id") < 300, "big").when(F.col("id") < 390, "mid").otherwise("small").alias("source"),
    )
    out = mix(docs)
    assert out.columns == docs.columns
    n = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert n["big"] == 300 and n["small"] == 20 and 90 < n["mid"] < 180
    assert out.select("doc_id").distinct().count() == 400
    blocks = mixed_blocks(docs).collect()
    assert Counter(r.source for r in blocks) == n
    for r in blocks:
        assert r.block in (0, 1)
    # a block is a seeded permutation: running tokens follow the hash order
    mid = sorted((md5(SEED, 1, r.doc_id), r.tokens_until) for r in blocks if r.source == "mid" and r.block == 1)
    assert [t for _, t in mid] == [4 * (k + 1) for k in range(len(mid))]


def test_exponent_for_entropy(spark):
    shares = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "stratum string, tokens bigint")
    a = exponent(shares, None, 0.9)
    import math

    p = [x**a for x in (0.9, 0.09, 0.01)]
    p = [x / sum(p) for x in p]
    assert abs(-sum(x * math.log(x) for x in p) / math.log(3) - 0.9) < 1e-3
    with pytest.raises(ValueError):
        exponent(shares, None, None)


def test_rows_without_an_id_meet_the_quota(spark):
    rows = [(None, f"one two three w{i}", "small") for i in range(30)] + [(i, "one two three four", "big") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    n = Counter(r.source for r in mix(docs, max_repetition=1.6).collect())
    # the small source is read 1.6 times at most against the big one's once; only a last block's remainder is left out
    with_ids = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(1000) + F.xxhash64("text")))
    assert n == Counter(r.source for r in mix(with_ids, max_repetition=1.6).collect()) and 30 < n["small"] < 120
    assert Counter(r.source for r in mixed_blocks(docs, max_repetition=1.6).collect()) == n


def test_mixture_of_odd_rows(odd, odd_rows, empty):
    out = mix(odd)
    assert out.columns == odd.columns
    got = Counter(map(str, out.collect()))
    assert all(got[str(r)] >= 1 for r in odd.collect())
    assert max(got[str(r)] / Counter(map(str, odd.collect()))[str(r)] for r in odd.collect()) <= MAX_REPETITION
    assert mixed_blocks(odd).count() == out.count()
    assert mix(empty).count() == 0 and mixed_blocks(empty).count() == 0


def test_lines_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    rows = docs.collect()
    pages, held = Counter(r.source for r in rows), Counter()
    for r in rows:
        for line in {x.strip(" ") for x in r.text.split("\n")}:
            held[r.source, line] += 1

    def keep(r, ratio, least):
        return "\n".join(
            x for x in r.text.split("\n")
            if not x.strip(" ") or pages[r.source] < least or held[r.source, x.strip(" ")] / pages[r.source] <= ratio
        )

    for ratio, least in ((0.1, 10), (0.1, 2), (0.3, 5)):
        got = {r.doc_id: r.text for r in line_dedup(docs, F.col("source"), ratio=ratio, min_pages=least).collect()}
        assert got == {r.doc_id: keep(r, ratio, least) for r in rows}


def test_lines_of_odd_rows(spark, odd, odd_rows, empty):
    out = line_dedup(odd, F.col("source"), ratio=0.4, min_pages=2)
    assert out.columns == odd.columns and out.count() == len(odd_rows)
    text = {r.doc_id: r.text for r in out.collect() if r.doc_id}
    assert text[1] is None and text[2] == "" and text[8] == "" and text[3] == " \n\t "
    assert line_dedup(empty, F.col("source"), counts=True).count() == 0
    hosts = spark.createDataFrame([("http://User@Ex.COM:80/a",), ("nothing",), (None,)], "u string").select(host_of(F.col("u")).alias("h"))
    assert [r.h for r in hosts.collect()] == ["ex.com", None, None]
