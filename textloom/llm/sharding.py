"""Sharding by proportional stratified interleaving (DataFrame functions only).

Every source is shuffled by a seeded hash and its rows are ranked; a row's
fractional rank is ``(rank - 1/2) / rows of the source``. All rows sorted by
fractional rank form one interleaved sequence in which any contiguous run holds
the sources in the proportions of the whole, so equal contiguous cuts give
shards of the same mixture whose row counts differ by one at most.

No rank is computed in one task: rows are counted by small hash (or fraction)
buckets, a running sum over those counts gives each bucket's offset, and rows
are only numbered inside their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import cut, table

SHARDS = 24
SEED = "shard-1"
#: Rows that one ranking bucket may hold on average; the number of buckets grows with the input.
BUCKET_ROWS = 20_000


def hex_digits(rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    """Leading hex digits of a hash that split ``rows`` into small buckets."""
    digits = 2
    while digits < 6 and 16**digits * per_bucket < rows:
        digits += 1
    return digits


def seeded(seed: str, *keys: Column) -> Column:
    """A portable seeded hash (32 hex digits) of the keys."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]).cast("binary"))


def stratum(source: Column) -> Column:
    """The source as a join key in which null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def interleaved(rows: DataFrame, n_rows: int, seed: str = SEED) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32, stratum) with ``frac`` and ``order`` columns.

    Rows alike in all four columns are interchangeable.
    """
    digits = hex_digits(n_rows)
    # rows without an id are told apart by their texts
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.col("text_crc32"), F.lit("-"), F.col("size")))
    keyed = rows.withColumn("order", seeded(seed, key)).withColumn("part", F.substring("order", 1, digits))
    by = Window.partitionBy("stratum").orderBy("part")
    offsets = (
        keyed.groupBy("stratum", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "stratum",
            "part",
            F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
            F.sum("n").over(Window.partitionBy("stratum")).alias("of_stratum"),
        )
    )
    within = Window.partitionBy("stratum", "part").orderBy("order", "doc_id", "text_crc32", "size")
    return (
        keyed.withColumn("nth", F.row_number().over(within))
        .join(offsets, ["stratum", "part"])
        .withColumn("frac", (F.col("before") + F.col("nth") - F.lit(0.5)) / F.col("of_stratum"))
        .select("doc_id", "size", "text_crc32", "stratum", "order", "frac")
    )


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = SEED,
) -> DataFrame:
    """Assign every row of ``docs`` to one of ``shards`` shards under the law ``rows``.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard,
    slot (gapless from 0 in each shard) and grown_shard (null under this law).

    Null source: a source of its own. Null text: no bytes, crc32 of nothing (0).
    Null doc_id: ordered by a hash of the text's size and crc32. Repeated rows: each is
    placed. Ties in fractional rank: by source, then hash, then doc_id. Empty
    table: no rows. Other columns of ``docs`` are not looked at.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        stratum(F.col(source_col).cast("string")).alias("stratum"),
    )
    n_rows = docs.count()
    ranked = cut(interleaved(rows, n_rows, seed))
    buckets = 16 ** hex_digits(n_rows)
    ranked = ranked.withColumn("part", F.floor(F.col("frac") * buckets).cast("int"))
    offsets = (
        ranked.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "part",
            F.coalesce(
                F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("before"),
        )
    )
    within = Window.partitionBy("part").orderBy("frac", "stratum", "order", "doc_id", "text_crc32", "size")
    at = F.col("before") + F.row_number().over(within) - F.lit(1)
    # integer arithmetic: the first position of shard s is ceil(s * n / shards)
    number = F.expr(f"cast((at * {shards}L) div {max(n_rows, 1)}L as int)")
    first = F.expr(f"(shard * {n_rows}L + {shards - 1}L) div {shards}L")
    return (
        ranked.join(offsets, "part")
        .withColumn("at", at)
        .withColumn("shard", number)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("at") - first).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op4_stratified_shards(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))


#: crc32 is written out with its table (the reversed polynomial 0xEDB88320).
OP4_SQL = f"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), rows AS (
  SELECT doc_id, coalesce('=' || source, 'null') AS stratum, strlen(coalesce(text, ''))::BIGINT + 8 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
          list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM documents, crc
), hashed AS (
  SELECT *, md5('{SEED}|' || coalesce(doc_id::VARCHAR, 't' || text_crc32 || '-' || size)) AS h FROM rows
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 0.5::DOUBLE)
    / count(*) OVER (PARTITION BY stratum) AS frac FROM hashed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY frac, stratum, h, doc_id NULLS FIRST, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM ranked
), cuts AS (
  SELECT *, ((pos * {SHARDS}) // n)::INTEGER AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, (pos - (shard * n + {SHARDS} - 1) // {SHARDS})::BIGINT AS slot,
  NULL::INTEGER AS grown_shard FROM cuts
"""
