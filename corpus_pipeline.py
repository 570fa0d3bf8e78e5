"""A corpus pipeline: each stage applies one operator of ``textloom.llm`` to all rows its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of ``documents``.

Odd rows, in every stage: rows without an id and repeated rows are rows like others
(near_duplicates keeps one of equal ones); ties are broken by ids and hashes, so
each stage gives the same rows however its input is dealt out; an empty table gives
no rows; further columns of any names pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import langid, lines, mixing, neardup, packing
from textloom.session import cut, discard, table

#: A document whose language is less certain than this is rejected.
LEAST_CERTAIN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language: without a letter, or with no language likelier than all others together.

    Null, empty and letterless texts go. A table that names no language keeps nothing.
    Texts of any length are judged whole.
    """
    model = langid.fit(docs, F.lit(True))
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    found = langid.predict(docs.toDF(*names), model, text_col=text)
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN))
    return kept.select(*names).toDF(*docs.columns)


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop boilerplate lines of each source; copies are one page, so that the next stage finds a whole text to keep.

    Null source: a site of its own. Null text: stays. A text of boilerplate alone stays, empty.
    """
    return lines.line_dedup(docs, F.col("source"), copies_once=True, least=lines.LEAST_PAGES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates: that of the least id.

    Null and empty texts are one class; texts without words are like equal ones only.
    """
    return neardup.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents of small sources until the mixture meets its target.

    Null source: a source of its own. Null or blank text: no tokens; a source of such texts is read once.
    """
    return mixing.mix(docs, max_repetition=mixing.MAX_REPETITION)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack every document into sequences; null text: the end id alone."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("language", language),
    ("site_lines", site_lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packed", packed),
]

#: Models, signatures and tokenizers have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        kept = cut(stage(spark, docs, sf_dir))
        discard(docs)
        docs = kept
    return docs
