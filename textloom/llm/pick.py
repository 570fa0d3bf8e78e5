"""Fetching the few texts that a step still needs without shuffling all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: 1,024 bitmaps of 32,768 bits, 4 MB however large the corpus.
SLOTS = 1 << 25
_BITMAP = 1 << 15


def _slot(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("pick"), *keys), F.lit(SLOTS))


def pick(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` (doc_id, v, text) joined with ``wanted`` (of, rep, ...) on v = of and doc_id = rep, nulls being equal.

    A bitmap of the wanted keys' hashes, of fixed size, is broadcast and most other
    rows are dropped where they are read; the join is exact. A corpus so large that
    it fills the bitmap only shuffles more texts.
    """
    key = _slot(F.col("of"), F.col("rep"))
    bits = wanted.select((key / F.lit(_BITMAP)).cast("int").alias("bucket"), F.pmod(key, F.lit(_BITMAP)).alias("bit"))
    bits = bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    slot = _slot(F.col("v"), F.col("doc_id"))
    at = F.pmod(slot, F.lit(_BITMAP)).cast("int")
    maybe = rows.withColumns({"bucket": (slot / F.lit(_BITMAP)).cast("int"), "at": at}).join(F.broadcast(bits), "bucket")
    octet = "cast(conv(hex(substring(bits, int(at div 8) + 1, 1)), 16, 10) as int)"
    maybe = maybe.filter(F.expr(f"shiftright({octet}, at % 8) % 2 = 1")).drop("bucket", "at", "bits")
    return maybe.join(wanted, (F.col("v") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("rep")))
