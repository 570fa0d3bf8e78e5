"""Mixing sources to target weights by temperature (DataFrame functions only).

A source's token share ``p`` is raised to an exponent between 0 and 1; the
exponent is bisected until the flattened mixture meets a target, either

* ``max_repetition``: no source is repeated more often than this relative to the
  least repeated one, or
* ``target_entropy``: the entropy of the weights, as a fraction of its maximum.

The budget is the smallest that leaves out no row: the least repeated source is
read once. Weights become whole tokens for each source (its quota), and a quota
becomes blocks: seeded permutations of the whole source, the last cut where the
remaining tokens are used up.

Only sums leave the executors: the smallest and largest share, or one entropy
for each step of the bisection. Cumulative tokens are never summed in one task:
hash buckets are summed first and rows are only accumulated inside a bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.sharding import hex_digits, seeded, stratum
from textloom.session import cut, table

SEED = "mix-1"
MAX_REPETITION = 2.0
#: Digits of the exponent that count; finer steps change no quota that matters.
EXPONENT_DIGITS = 6


def bisect(meets, low: float = 0.0, high: float = 1.0, steps: int = 40) -> float:
    """The smallest exponent in [low, high] for which ``meets`` holds; it must hold from some point on."""
    if meets(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if meets(mid) else (mid, high)
    return round(high, EXPONENT_DIGITS)


def exponent(shares: DataFrame, max_repetition: float | None, target_entropy: float | None) -> float:
    """Bisect the exponent. ``shares``: one row for each source with its tokens (> 0)."""
    if (max_repetition is None) == (target_entropy is None):
        raise ValueError("give either max_repetition or target_entropy")
    if max_repetition is not None:
        if max_repetition < 1:
            raise ValueError("max_repetition must be 1 or more")
        least, most = shares.agg(F.min("tokens"), F.max("tokens")).first()
        if not least:
            return 1.0
        return bisect(lambda a: (most / least) ** (1 - a) <= max_repetition * (1 + 1e-12))
    total, n = shares.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if n < 2:
        return 1.0

    def flat_enough(a: float) -> bool:
        power = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))
        z, zl = shares.agg(F.sum(power), F.sum(power * F.log(power))).first()
        return (math.log(z) - zl / z) / math.log(n) < target_entropy

    # entropy falls as the exponent rises: find where it drops under the target and stop just before
    return bisect(flat_enough, steps=20)


def key_of(id_: Column, text: Column) -> Column:
    """What a row is ordered by: its id, or a digest of its text if it has none."""
    return F.coalesce(id_.cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def mix_plan(
    docs: DataFrame,
    max_repetition: float | None = MAX_REPETITION,
    target_entropy: float | None = None,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): the rows' stratum and tokens, and each source's quota and cut.

    plan: stratum, tokens, quota, full (whole blocks), rest (tokens of the last
    block), cut (the largest hash of the last block's permutation that still fits;
    empty if none does). Rows of one key are kept or left together.
    """
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            key_of(F.col(id_col), F.col(text_col)).alias("key"),
            stratum(F.col(source_col).cast("string")).alias("stratum"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"\S+")), F.lit(0)).cast("bigint").alias("tokens"),
        )
    )
    shares = cut(rows.groupBy("stratum").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")))
    used = shares.filter("tokens > 0")
    a = exponent(used, max_repetition, target_entropy)
    n_rows, most = shares.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("tokens"), F.lit(0))).first()
    quota = F.when(
        F.col("tokens") > 0,
        F.floor(F.col("tokens") * F.pow(F.lit(float(most)) / F.col("tokens"), F.lit(1.0 - a)) + F.lit(0.5)),
    ).otherwise(F.lit(0))
    plan = (
        shares.select("stratum", "tokens", quota.cast("bigint").alias("quota"))
        .withColumn("full", F.expr("if(tokens > 0, quota div tokens, 1L)"))
        .withColumn("rest", F.expr("if(tokens > 0, quota % tokens, 0L)"))
    )
    last = rows.join(plan.filter("rest > 0").select("stratum", "full", "rest"), "stratum").select(
        "stratum", "rest", "tokens", seeded(seed, F.col("full"), F.col("key")).alias("order")
    )
    summed = accumulate(last, ["stratum"], n_rows)
    cuts = summed.filter("until <= rest").groupBy("stratum").agg(F.max("order").alias("cut"))
    return rows, cut(plan.join(cuts, "stratum", "left").withColumn("cut", F.coalesce("cut", F.lit(""))))


def accumulate(rows: DataFrame, keys: list[str], n_rows: int) -> DataFrame:
    """``until``: tokens of all rows of the same keys up to and including this ``order``."""
    rows = rows.withColumn("part", F.substring("order", 1, hex_digits(n_rows)))
    sums = rows.groupBy(*keys, "part").agg(F.sum("tokens").alias("of_part"))
    running = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "part", F.coalesce(F.sum("of_part").over(running), F.lit(0)).alias("before"))
    within = Window.partitionBy(*keys, "part").orderBy("order").rangeBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("in_part", F.sum("tokens").over(within))
        .join(sums, [*keys, "part"])
        .withColumn("until", F.col("before") + F.col("in_part"))
        .drop("in_part", "before", "part")
    )


def appearances(full: Column, cut_at: Column, key: Column, seed: str) -> Column:
    """The blocks a row appears in, as an array: every whole block, and the last if its hash is within the cut."""
    return F.when(
        seeded(seed, full, key) <= cut_at, F.sequence(F.lit(0).cast("bigint"), full)
    ).otherwise(F.sequence(F.lit(0).cast("bigint"), full - 1))


def mix(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **target) -> DataFrame:
    """``docs`` with every row as often as its source's quota says, columns unchanged.

    Texts are not shuffled: the decision is a hash compared with the source's cut.
    A third of all rows may be of one source; the join on the source is a broadcast
    while Spark finds the plan small, else a sort-merge join that splits skewed keys.

    Null source: a source of its own. Null or blank text: no tokens; a source
    without tokens is read once. Null doc_id: ordered by a digest of the text. Repeated rows:
    appear together. Columns of any names pass through. Empty table: no rows.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    of = {k: names[docs.columns.index(c)] for k, c in (("id_col", id_col), ("text_col", text_col), ("source_col", source_col))}
    _, plan = mix_plan(inner, seed=seed, **of, **target)
    plan = plan.select("stratum", "full", "cut")
    joined = inner.withColumn("stratum", stratum(F.col(of["source_col"]).cast("string"))).join(plan, "stratum")
    blocks = appearances(F.col("full"), F.col("cut"), key_of(F.col(of["id_col"]), F.col(of["text_col"])), seed)
    return joined.withColumn("block", F.explode(blocks)).select(*names).toDF(*docs.columns)


def mixed_blocks(docs: DataFrame, seed: str = SEED, **target) -> DataFrame:
    """The mixture as rows: doc_id, source, tokens, block, and the tokens of the block up to the row's end.

    Null source: a source of its own. Null or blank text: no tokens; a source without
    tokens is read once. Null doc_id: ordered by a digest of the text. Repeated rows and rows that
    share an id: appear together, and each counts the tokens of all of them. Texts of
    any length: counted whole. Empty table: no rows.
    """
    rows, plan = mix_plan(docs, seed=seed, **target)
    n_rows = rows.count()
    each = (
        rows.join(plan.select("stratum", "full", "cut"), "stratum")
        .withColumn("block", F.explode(appearances(F.col("full"), F.col("cut"), F.col("key"), seed)))
        .select("stratum", "block", "doc_id", "tokens", seeded(seed, F.col("block"), F.col("key")).alias("order"))
    )
    done = accumulate(each, ["stratum", "block"], n_rows)
    source = F.expr("if(stratum = 'null', null, substring(stratum, 2))")
    return done.select("doc_id", source.alias("source"), "tokens", "block", F.col("until").alias("tokens_until"))


def op3_temperature_mixing(spark, sf_dir):
    return mixed_blocks(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '\\S+')), 0)::BIGINT AS tokens,
    coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) AS key FROM documents
), shares AS (
  SELECT source, sum(tokens)::BIGINT AS tokens FROM rows GROUP BY source
), ends AS (
  SELECT min(tokens) AS least, max(tokens) AS most FROM shares WHERE tokens > 0
), a AS (
  SELECT most, CASE WHEN most / least <= {MAX_REPETITION} THEN 0.0
    ELSE round(1 - ln({MAX_REPETITION}) / ln(most / least), {EXPONENT_DIGITS}) END AS a FROM ends
), plan AS (
  SELECT source, tokens, CASE WHEN tokens > 0
    THEN floor(tokens * pow(most::DOUBLE / tokens, 1.0 - a) + 0.5)::BIGINT ELSE 0 END AS quota FROM shares, a
), cuts AS (
  SELECT source, tokens, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS whole,
         CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest FROM plan
), each AS (
  SELECT r.doc_id, r.source, r.tokens, b.block, whole, rest,
         md5('{SEED}|' || b.block || '|' || r.key) AS h
  FROM rows r JOIN cuts c ON r.source IS NOT DISTINCT FROM c.source
  CROSS JOIN LATERAL (SELECT unnest(range(0, c.whole + 1)) AS block) b
), done AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source, block ORDER BY h RANGE UNBOUNDED PRECEDING)::BIGINT AS tokens_until FROM each
)
SELECT doc_id, source, tokens, block, tokens_until FROM done WHERE block < whole OR (rest > 0 AND tokens_until <= rest)
"""
