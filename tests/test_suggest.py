"""Closeness of names against a plain version, and how a symbol is met."""

import re

from pyspark.sql import functions as F

from textloom.operators.suggest import closeness, match

NAMES = ["loadAll", "LoadAll", "load_all", "loader", "allLoad", "load-all:now", "AllLoaded", "x", "", "__", "HTTPServer2Load", "dAoLl", "ïload", "loadall2"]


def plain(name, query):
    norm = lambda x: re.sub("[^A-Za-z0-9]", "", x).lower()
    a, b = norm(name), norm(query)
    if not a or not b:
        return 0
    if a == b:
        return 100
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    if a in b or b in a:
        return 80 + shorter * 20 // longer
    words = lambda x: [w for w in re.split("[_ :-]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", re.sub("[^A-Za-z0-9_ :-]", "", x)).lower()) if w]
    shared = sum(w in words(query) for w in words(name))
    by_word = 30 + shared * 70 // max(len(words(name)), len(words(query))) if shared else 0
    at = n = 0
    for c in a:
        if at < len(b) and b.find(c, at) >= 0:
            at, n = b.find(c, at) + 1, n + 1
    prefix = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return max(by_word, (n * 70 + prefix * 30) // longer)


def test_closeness_matches_a_plain_version(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "name string")
    for query in ("loadAll", "all_load", "server", "Zq9", "", "LoadAllNow2"):
        got = {r.name: r.s for r in rows.select("name", closeness(F.col("name"), query).alias("s")).collect()}
        assert got == {n: plain(n, query) for n in NAMES}, query


def test_how_a_symbol_is_met(spark):
    rows = spark.createDataFrame([("loadAll", "Store", 1), ("load_all", None, 2), ("loadAll", "Other", 3), ("unload", "Store", 4), ("zzz", "Q", 5)], "name string, owner string, ord bigint")
    assert [(r.ord, r.score, r.how) for r in match(rows, "loadAll", 3).collect()] == [(1, 1000, "exact"), (3, 1000, "exact"), (2, 900, "normal")]
    got = [(r.ord, r.score, r.how) for r in match(rows, "store::LOADALL", 2).collect()]
    assert got[0] == (1, 850, "owned") and got[1][2] == "fuzzy"
