"""Source divergence audit: how the sources of a language differ from it and from each other, and by which terms.

A term's share p in a group (language, source), or q in a language, is an integer number of
billionths, smoothed by two occurrences; the triangular discrimination of two shares is
``f(p, q) = floor((p - q)^2 / (p + q))``. All arithmetic is on 64-bit integers.

* **Terms**: the ``top`` terms of a group that it uses more than its language, by f. A group's
  terms are put in buckets by count. The largest p and the least q of a bucket bound f for all its
  terms, since f rises with p and falls with q below it. Buckets are evaluated
  best bound first, some at a time, until every unseen bound is strictly below the
  group's ``top``-th value; terms of other buckets are never evaluated.
* **Pairs**: sources of one language, by the sum of f over all kept terms. Terms that both
  use are found in the terms' postings, a task at a time; a term that one of them uses counts by its number
  of occurrences, of which a group has few different ones; terms of neither all have one value.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.textvec import release, slices, texts_of
from textloom.session import cut, discard, table

#: A term is kept if it stands in as many documents of its language.
MIN_DOCS = 10
TOP = 10
#: (group, term) entries that a task counts before it hands them on.
HELD = 300_000
#: Terms evaluated first for each group; the next step reaches eight times as far.
FIRST = 64
#: Sources of a tile of pairs, and cells of pairs that a task holds.
TILE = 256
CELLS = 1 << 21
BILLION = 1_000_000_000

#: Bytes that are no part of a term become spaces, A-Z become small.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text, in order: runs of A-Z, a-z and characters beyond ASCII, with A-Z made small."""
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(n), pa.string()),
                    pa.array([source] * len(n), pa.string()),
                    pa.array([t.decode("utf-8", "surrogatepass") for t in n], pa.string()),
                    pa.array(list(n.values()), pa.int64()),
                    pa.array([docs[t] for t in n], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    for batch in (part for whole in batches for part in slices(whole, 2)):
        for lang, source, text in zip(*(texts_of(c) for c in batch.columns), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found, before = Counter(terms_of(text)), len(n)
            n.update(found)
            docs.update(found.keys())
            size += len(n) - before
            if size > HELD:
                yield from out()
                held.clear()
                size = 0
    yield from out()
    held.clear()
    release()


def f(p: Column, q: Column) -> Column:
    d = p - q
    return F.call_function("div", d * d, p + q)


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(BILLION * (count + 2) / (n + 2 * v)), three decimal digits at a time, so that no product leaves 64 bits."""
    size, left, out = n + 2 * v, count + 2, F.lit(0).cast("bigint")
    for _ in range(3):
        out, left = out * 1000 + F.call_function("div", left * 1000, size), (left * 1000) % size
    return out + 1


def bucket(count: Column) -> Column:
    """Counts below 32 are buckets of their own; beyond, sixteen to a power of two."""
    bits = F.length(F.bin(count))
    return F.when(count < 32, count).otherwise(bits * 16 + F.call_function("shiftright", count, bits - 5) % 16).cast("int")


class Audit:
    """The counted terms of a table and the figures of its groups.

    cells: lang, source, term, n (occurrences), p, q of every kept term of a group.
    groups: lang, source, place (in the language, by name), size and kinds (N and V), none (p of an absent term).
    """

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text"):
        named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"))]
        rows = docs.select(*named, F.col(text_col).alias("text"))
        parts = rows.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
        # all rows of a term meet in one place: those of its groups are summed there, and then its languages
        of_term = Window.partitionBy("lang", "term")
        counted = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        counted = counted.withColumns({"docs": F.sum("docs").over(of_term), "total": F.sum("n").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
        self.kept = cut(counted.filter(F.col("docs") >= min_docs).drop("docs"))
        sizes = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
        langs = self.kept.filter("first").groupBy("lang").agg(F.sum("total").alias("all"), F.count(F.lit(1)).alias("kinds"))
        known = rows.select("lang", "source").distinct().join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
        known = known.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "all", "kinds")])
        place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        none = F.when(F.col("kinds") > 0, share(F.lit(0).cast("bigint"), F.col("size"), F.greatest("kinds", F.lit(1))))
        self.groups = cut(known.withColumns({"place": place, "none": none}))
        of_group = self.groups.select("lang", "source", "place", "size", "all", "kinds")
        self.cells = cut(
            self.kept.join(of_group, ["lang", "source"]).select(
                "lang", "source", "place", "term", "n", share(F.col("n"), F.col("size"), F.col("kinds")).alias("p"),
                share(F.col("total"), F.col("all"), F.col("kinds")).alias("q"),
            )
        )
        discard(self.kept)

    def discard(self) -> None:
        discard(self.groups, self.cells)

    def terms(self, top: int = TOP, first: int = FIRST) -> DataFrame:
        """lang, source, term, value, rank: the ``top`` terms of each group by f, of those with p > q."""
        group = ["lang", "source"]
        over = self.cells.filter("p > q").withColumn("bucket", bucket(F.col("n")))
        best_first = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
        buckets = over.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("terms"), f(F.max("p"), F.min("q")).alias("bound"))
        buckets = cut(buckets.withColumn("before", F.coalesce(F.sum("terms").over(best_first), F.lit(0))))
        ranked = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "term"))
        best, seen, reach = None, 0, first
        while True:
            open_ = buckets.filter(F.col("before") >= seen)
            if best is not None:
                kth = best.filter(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
                open_ = open_.join(kth, group, "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
                if open_.isEmpty():
                    break
            now = open_.filter(F.col("before") < reach).select(*group, "bucket")
            found = over.join(now, [*group, "bucket"]).select(*group, "term", f(F.col("p"), F.col("q")).alias("value"))
            found = found if best is None else found.unionByName(best.drop("rank"))
            old, best = best, cut(found.withColumn("rank", ranked).filter(F.col("rank") <= top))
            if old is not None:
                discard(old)
            seen, reach = reach, reach * 8
        discard(buckets)
        return best

    def pairs(self, tile: int = TILE) -> DataFrame:
        """lang, source, other, value: every ordered pair of sources of a language, by the sum of f over all kept terms.

        As many rows as there are pairs of sources, which is the result asked for.
        """
        groups, key = self.groups, ["lang", "a", "b"]
        left = groups.select("lang", *[F.col(c).alias(f"a{i}") for i, c in enumerate(("place", "none", "kinds"))])
        right = groups.select("lang", *[F.col(c).alias(f"b{i}") for i, c in enumerate(("place", "none"))])
        zero = F.lit(0).cast("bigint")
        # terms of neither: all V at first; what follows adds the difference for terms of one, and of both
        base = left.join(right, "lang").filter("a0 < b0").select(
            "lang", F.col("a0").alias("a"), F.col("b0").alias("b"), F.when(F.col("a2") > 0, F.col("a2") * f(F.col("a1"), F.col("b1"))).otherwise(zero).alias("value")
        )
        often = self.cells.groupBy("lang", F.col("place").alias("at"), "p").agg(F.count(F.lit(1)).alias("terms"))
        alone = left.select("lang", F.col("a0").alias("at"), F.col("a1").alias("mine")).join(often, ["lang", "at"]).join(right, "lang").filter("at <> b0")
        alone = alone.select(
            "lang", F.least("at", "b0").alias("a"), F.greatest("at", "b0").alias("b"),
            (F.col("terms") * (f(F.col("p"), F.col("b1")) - f(F.col("mine"), F.col("b1")))).alias("value"),
        )
        values = base.unionByName(alone.groupBy(*key).agg(F.sum("value").alias("value"))).unionByName(self._shared(tile))
        summed = cut(values.groupBy(*key).agg(F.sum("value").alias("value")))
        both = summed.unionByName(summed.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
        name = lambda at, as_: groups.select("lang", F.col("place").alias(at), F.col("source").alias(as_))
        out = cut(both.join(name("a", "source"), ["lang", "a"]).join(name("b", "other"), ["lang", "b"]).select("lang", "source", "other", "value"))
        discard(summed)
        return out

    def _shared(self, tile: int) -> DataFrame:
        """lang, a, b, value: what terms of both add to a pair of sources, beyond what each of them adds alone."""
        none = self.groups.select("lang", "place", "none")
        entry = F.struct("place", "p", "none")
        posting = (
            self.cells.join(none, ["lang", "place"])
            .repartition("lang", "term")
            .groupBy("lang", "term", F.floor(F.col("place") / tile).alias("tile"))
            .agg(F.sort_array(F.collect_list(entry)).alias("of"))  # a tile's entries at most
        )
        posting = cut(posting)
        other = posting.select("lang", "term", F.col("tile").alias("tile2"), F.col("of").alias("of2"))
        met = posting.join(other, ["lang", "term"]).filter("tile <= tile2").select("lang", "tile", "tile2", "of", "of2")
        parts = met.mapInArrow(partial(_pair_sums, tile), "lang string, a int, b int, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        summed = cut(parts)
        discard(posting)
        return summed


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _pair_sums(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tiles: dict[tuple[str, int, int], np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, i, j), sums in tiles.items():
            a, b = np.nonzero(sums)
            columns = [pa.array([lang] * len(a), pa.string()), pa.array((a + i * size).astype(np.int32)), pa.array((b + j * size).astype(np.int32)), pa.array(sums[a, b])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

    def entries(column) -> tuple[np.ndarray, ...]:
        inner = column.flatten()
        starts = np.concatenate(([0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))))
        return starts, *[inner.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]

    for batch in batches:
        langs, first, second = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        s1, at1, p1, none1 = entries(batch.column(3))
        s2, at2, p2, none2 = entries(batch.column(4))
        for k, lang in enumerate(langs):
            i, j = int(first[k]), int(second[k])
            tile = tiles.get((lang, i, j))
            if tile is None:
                if len(tiles) * size * size >= CELLS:
                    yield from out()
                    tiles.clear()
                tile = tiles[lang, i, j] = np.zeros((size, size), np.int64)
            x, y = slice(s1[k], s1[k + 1]), slice(s2[k], s2[k + 1])
            p, u, q, w = p1[x, None], none1[x, None], p2[None, y], none2[None, y]
            more = _f(p, q) - _f(p, w) - _f(u, q) + _f(u, w)
            a, b = at1[x] - i * size, at2[y] - j * size
            if i == j:
                more = np.where(a[:, None] < b[None, :], more, 0)
            tile[a[:, None], b[None, :]] += more
    yield from out()
    tiles.clear()
    release()


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, tile: int = TILE, **columns: str) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank.

    Null text, lang and source count as empty. Repeated rows: each is a document. A group
    without terms, or of a language without kept terms, has pairs (of value 0 if none is kept) and no
    terms. Equal values: by item, bytewise. Texts of any length: read whole.
    Other columns, of any names, are not looked at. Empty table: no rows.
    """
    found = Audit(docs, min_docs, **columns)
    terms, pairs = found.terms(top), found.pairs(tile)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other"))
    out = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", rank.alias("rank")).unionByName(
        terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    )
    found.discard()
    return out


def op11_source_divergence(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP11_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents
), tokens AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS total FROM tokens GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}
), langs AS (SELECT lang, sum(total)::HUGEINT AS n, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), counts AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM tokens JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM counts GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(s.n, 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes s USING (lang, source)
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    1 + ({BILLION}::HUGEINT * (coalesce(c.c, 0) + 2)) // (g.n + 2 * l.v) AS p, 1 + ({BILLION}::HUGEINT * (k.total + 2)) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::HUGEINT AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM cells WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
