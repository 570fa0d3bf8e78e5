"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's ratio is the number of the host's pages that
hold it divided by all pages of the host; lines above the boilerplate ratio are
dropped from the pages of that host.

Each page contributes a line once, counts are summed before the shuffle, and only
lines above the ratio travel on: at most (mean lines of a page / ratio) for each
host. Texts are filtered in place by their host's list and are only shuffled if
Spark finds the lists too large to broadcast, in which case it splits hot hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import cut, table

RATIO = 0.1
MIN_PAGES = 10
#: Distinct pages that a line stands on at least before the pipeline drops it: two may be a page and its near copy.
LEAST_PAGES = 3


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(F.nullif(host, F.lit("")))


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def line_dedup(
    docs: DataFrame,
    host: Column,
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    counts: bool = False,
    copies_once: bool = False,
    least: int = 1,
) -> DataFrame:
    """``docs`` without boilerplate lines, columns and rows as they were.

    With ``counts``, the columns n_lines and n_dropped are added. A line is
    compared without the spaces around it, by a 64-bit hash; blank lines stay. A
    host with fewer than ``min_pages`` pages keeps every line. Null host: a host of
    its own. Null text: stays null, holds no line, its page counts. Repeated rows:
    each counts as a page. A page of boilerplate alone stays with an empty text.
    A ratio equal to the limit is kept. Empty table: no rows.

    With ``copies_once``, pages of a host with the same lines count as one page, both
    where a line's pages and where the host's are counted, so that copies do not make
    each other's text boilerplate. A line on fewer than ``least`` pages stays. Near
    copies count as separate pages.
    """
    # numbered names, so that columns of any names pass through
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.select("*", F.coalesce(F.concat(F.lit("="), host), F.lit("null")).alias("site")).toDF(*names, "site")
    text = F.col(names[docs.columns.index(text_col)])
    split = F.split(text, "\n", -1)
    solid = F.filter(split, lambda x: F.trim(x) != "")
    pages = inner.select("site", F.array_distinct(F.transform(solid, _key)).alias("lines"))
    if copies_once:
        pages = pages.distinct()
    totals = pages.select("site").groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    held = (
        pages.select("site", F.explode("lines").alias("line"))
        .groupBy("site", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") >= ratio * min_pages) & (F.col("n") >= least))
    )
    boilerplate = cut(
        held.join(totals, "site")
        .filter((F.col("pages") >= min_pages) & (F.col("n") / F.col("pages") > ratio))
        .groupBy("site")
        .agg(F.collect_set("line").alias("drops"))
    )
    joined = inner.join(boilerplate, "site", "left")
    keep = F.filter(split, lambda x: (F.trim(x) == "") | ~F.array_contains("drops", _key(x)))
    kept = F.when(F.col("drops").isNull(), split).otherwise(keep)
    whole = F.when(F.col("drops").isNull(), text).otherwise(F.array_join(keep, "\n"))
    out = [whole if c == text_col else F.col(n) for c, n in zip(docs.columns, names, strict=True)]
    if counts:
        n = F.coalesce(F.size(split), F.lit(0)).cast("bigint")
        n = F.when(text.isNull(), F.lit(0).cast("bigint")).otherwise(n)
        dropped = F.when(text.isNull(), F.lit(0)).otherwise(F.size(split) - F.size(kept)).cast("bigint")
        out += [n, dropped]
    return joined.select(*out).toDF(*docs.columns, *(["n_lines", "n_dropped"] if counts else []))


def op9_site_lines(spark, sf_dir):
    """Documents by their source, the only site they name; every row counts as a page, as in ``OP9_SQL``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup(docs, F.col("source"), counts=True)


OP9_SQL = f"""
WITH pages AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source
), held AS (
  SELECT source, line, count(*) AS n FROM (
    SELECT source, unnest(list_distinct(list_transform(lines, lambda x: trim(x)))) AS line FROM pages) WHERE line <> '' GROUP BY ALL
), bad AS (
  SELECT h.source, list(h.line) AS drops FROM held h JOIN totals t ON h.source IS NOT DISTINCT FROM t.source
  WHERE t.pages >= {MIN_PAGES} AND n / t.pages > {RATIO} GROUP BY h.source
), kept AS (
  SELECT doc_id, p.source, text, lines,
    list_filter(lines, lambda x: trim(x) = '' OR NOT list_contains(coalesce(drops, []), trim(x))) AS kept
  FROM pages p LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
  coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped FROM kept
"""
