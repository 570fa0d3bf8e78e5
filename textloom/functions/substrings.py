"""Exact search of many strings in many texts, by rolling hashes.

A needle of n bytes belongs to the class of the largest power of two q <= n. Every place of a
text is looked up by the hash of its next q bytes in a bitmap of the needles' first q
bytes; places that pass, by the hash of n bytes in a bitmap of whole needles. What passes
both (the second at two slots) is handed on as a string and meets the needles by equality, so
the answer is exact. The bitmaps have ``ROOM`` slots for each needle, so the share of places that pass in vain
does not grow with the needles, up to a fixed size; what needles are beyond it are searched in further passes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of each bitmap for a needle, and at least and at most (32 MB) in all.
ROOM, LEAST, MOST = 32, 1 << 20, 1 << 28
#: Bytes of a text that are looked at together; pieces overlap by the longest needle.
PIECE = 1 << 19
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Rolling:
    """Hashes of any run of bytes of a string, each by two look-ups."""

    def __init__(self, data: bytes):
        points = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        self.size = len(points)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(points * _powers(_BASE, self.size), out=self.sums[1:])
        self.down = _powers(_INVERSE, self.size + 1)

    def of(self, at: np.ndarray, n: int) -> np.ndarray:
        h = (self.sums[at + n] - self.sums[at]) * self.down[at] + np.uint64(n)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(31))


def class_of(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def slots_for(needles: int, most: int = MOST) -> int:
    """Bits of a bitmap for so many needles: a power of two."""
    return min(max(LEAST, 1 << (ROOM * needles - 1).bit_length()), most) if needles else LEAST


def _low(h: np.ndarray, slots: int) -> np.ndarray:
    return (h & np.uint64(slots - 1)).astype(np.int64)


def _high(h: np.ndarray, slots: int) -> np.ndarray:
    return (h >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _slots(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for needle in batch.column(0).to_pylist():
                data = needle.encode("utf-8", "surrogatepass")
                hashed, start = Rolling(data), np.zeros(1, np.int64)
                first, whole = hashed.of(start, class_of(len(data))), hashed.of(start, len(data))
                rows += [(0, int(_low(first, slots)[0])), (1, int(_low(whole, slots)[0])), (1, int(_high(whole, slots)[0]))]
            kind, slot = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(slot, pa.int64())], names=["kind", "slot"])

    return run


def _held(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) == 1


def holders(texts: DataFrame, needles: DataFrame, id_col: str = "file_id", text_col: str = "text", piece_size: int = PIECE, most: int = MOST) -> DataFrame:
    """(id, needle): which texts contain which strings of ``needles`` (column ``needle``), each pair once.

    Null and empty needles: in no text. Null texts: hold nothing. Case counts. More needles than a
    bitmap of ``most`` bits has room for are dealt into several passes over the texts by their hash.
    """
    needles = needles.filter("needle <> ''").select("needle").distinct()
    n = needles.count()
    passes = max(1, -(-n * ROOM // (2 * most)))
    parts = [needles if passes == 1 else needles.filter(F.pmod(F.xxhash64("needle"), F.lit(passes)) == k) for k in range(passes)]
    passed = reduce(DataFrame.unionByName, [_passed(texts, part, slots_for(-(-n // passes), most), id_col, text_col, piece_size) for part in parts])
    return passed.join(needles, "needle", "left_semi").select(F.col("id").alias(id_col), "needle")


def _passed(texts: DataFrame, needles: DataFrame, slots: int, id_col: str, text_col: str, piece_size: int) -> DataFrame:
    """(id, needle): the strings in texts that pass the bitmaps of ``needles``, all needles among them."""
    hashed = needles.mapInArrow(_slots(slots), "kind int, slot bigint")
    # slots / 32,768 rows for each kind; a row for each length that needles have
    bits = hashed.groupBy("kind", F.expr("slot div 32768").alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits")).collect()
    packed = [np.zeros(slots // 8, np.uint8) for _ in range(2)]
    for r in bits:
        packed[r["kind"]][r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    lengths = defaultdict(list)
    for r in needles.select(F.octet_length("needle").alias("n")).distinct().collect():
        lengths[class_of(r["n"])].append(r["n"])
    longest = max((n for found in lengths.values() for n in found), default=0)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, whole = packed

        def found_in(data: bytes) -> set[bytes]:
            out: set[bytes] = set()
            for start in range(0, max(1, len(data)), piece_size):
                piece = data[start : start + piece_size + longest - 1]
                hashed = Rolling(piece)
                for q, sizes in lengths.items():
                    at = np.arange(min(piece_size, hashed.size - q + 1)) if hashed.size >= q else np.zeros(0, np.int64)
                    at = at[_held(first, _low(hashed.of(at, q), slots))]
                    for n in sizes:
                        fits = at[at + n <= hashed.size]
                        h = hashed.of(fits, n)
                        passed = _held(whole, _low(h, slots)) & _held(whole, _high(h, slots))
                        _, once = np.unique(h[passed], return_index=True)
                        out.update(piece[a : a + n] for a in fits[passed][once].tolist())
            return out

        for batch in batches:
            ids, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for x in found_in(text.encode("utf-8", "surrogatepass")) if text and longest else ():
                    try:
                        found.append(x.decode())
                    except UnicodeDecodeError:  # begins or ends inside a character: no needle
                        continue
                    ids.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(found, pa.string())], names=["id", "needle"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(F.col(id_col), F.col(text_col)).mapInArrow(find, f"id {kind}, needle string")


def grams(text, n: int):
    """The distinct runs of ``n`` characters of a short text (a name, a path)."""
    last = F.length(text) - n + 1
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.substr(text, k, F.lit(n))))


def containing(needles: DataFrame, names: DataFrame) -> DataFrame:
    """needles (needle) joined with names (name, ...) that contain them, by lists of the names that have each trigram.

    A needle looks only at the list of its rarest trigram (of its rarest single
    character or pair, if it is shorter), then names are compared in full.
    """
    needles = needles.filter("needle <> ''").select("needle").distinct().withColumn("n", F.least(F.length("needle"), F.lit(3)))
    sizes = F.array(*[F.struct(F.lit(n).alias("n"), grams(F.col("name"), n).alias("of")) for n in (1, 2, 3)])
    lists = names.select("*", F.explode(sizes).alias("s")).filter(F.length("name") >= F.col("s.n")).select(*names.columns, F.col("s.n").alias("n"), F.explode("s.of").alias("gram"))
    own = needles.withColumn("gram", F.explode(F.when(F.col("n") == 1, grams(F.col("needle"), 1)).when(F.col("n") == 2, grams(F.col("needle"), 2)).otherwise(grams(F.col("needle"), 3))))
    wanted = own.select("n", "gram").distinct()
    counts = lists.join(wanted, ["n", "gram"], "left_semi").groupBy("n", "gram").agg(F.count(F.lit(1)).alias("names"))
    # a trigram that no name has rules its needle out; the list is then empty
    rarest = own.join(counts, ["n", "gram"], "left").groupBy("needle", "n").agg(F.min_by("gram", F.struct(F.coalesce("names", F.lit(0)), F.col("gram"))).alias("gram"))
    return rarest.join(lists, ["n", "gram"]).filter(F.contains("name", F.col("needle"))).select("needle", *names.columns)


def endings(path):
    """The path and every part of it from a folder on, the longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
