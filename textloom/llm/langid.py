"""Language ID by word-first backoff.

A word that the model knows scores by its log frequency in each language. An
unseen word falls back to its character n-grams, the longest length first: the
first length at which any of its n-grams is known decides, by the mean log
frequency of those known. A text's score for a language is the sum over its words.

The model is fitted on a bounded sample of labelled rows (``sample_docs`` whole
texts for each language, chosen by a hash of the id) and holds at most
``entries`` words and n-grams of each length for each language, so its size does
not grow with the corpus. Every document is then scored whole, in one pass
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from textloom.llm.textvec import Lookup, Words, chunks, release, slices, texts_of
from textloom.session import table

SAMPLE_DOCS = 6_000
ENTRIES = 20_000
LENGTHS = (5, 4, 3, 2, 1)
#: Words of evidence at most that the confidence counts.
EVIDENCE = 20
UNKNOWN = "und"


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def sampled(rows: DataFrame, label: str, key: Column, most: int) -> DataFrame:
    """About ``most`` rows of each label (all, if fewer), by a hash of the key.

    One count for each label reaches the driver, as many as the model has columns.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    u = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(label) == F.lit(r[label]), min(1.0, most / r["n"])).otherwise(share)
    return rows.filter(u < share)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 0)):
        texts, langs = texts_of(batch.column(0)), np.array(batch.column(1).to_pylist(), object)
        for a, z in chunks(texts):
            words = Words(texts[a:z], letters=True)
            names, code = np.unique(langs[a:z], return_inverse=True)
            word_lang = code[words.doc_of_word()]
            for n in (0, *LENGTHS):
                if n:
                    long = np.flatnonzero(words.stop - words.begin >= n)
                    each = words.stop[long] - words.begin[long] - n + 1
                    at = np.repeat(words.begin[long], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    hashes, lang = words.grams(at, n), np.repeat(word_lang[long], each)
                else:
                    hashes, lang = words.hashes, word_lang
                for k, name in enumerate(names):
                    found, count = np.unique(hashes[lang == k], return_counts=True)
                    if len(found):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([name] * len(found), pa.string()),
                                pa.array(np.full(len(found), n, np.int32)),
                                pa.array(found.view(np.int64)),
                                pa.array(count.astype(np.int64)),
                            ],
                            names=["lang", "n", "hash", "count"],
                        )
    release()


class Model:
    """Log frequencies: for words and each n-gram length, hashes and one column for each language."""

    def __init__(self, counts: pd.DataFrame, totals: pd.DataFrame):
        self.langs = sorted(totals["lang"].unique()) if len(totals) else []
        code = {x: i for i, x in enumerate(self.langs)}
        self.tables: dict[int, tuple[Lookup, np.ndarray]] = {}
        for n in (0, *LENGTHS):
            part = counts[counts["n"] == n]
            hashes, row = np.unique(part["hash"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
            seen = np.zeros((len(hashes), len(self.langs)))
            seen[row, part["lang"].map(code).to_numpy(np.int64)] = part["count"]
            total = np.ones(len(self.langs))
            of_n = totals[totals["n"] == n]
            total[of_n["lang"].map(code).to_numpy(np.int64)] = of_n["total"]
            self.tables[n] = (Lookup(hashes), np.log((seen + 0.1) / (total + 0.1 * max(1, len(hashes)))))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log frequencies by language, words that counted) for each text."""
        words = Words(texts, letters=True)
        docs, n_docs = words.doc_of_word(), len(texts)
        total, seen = np.zeros((n_docs, len(self.langs))), np.zeros(n_docs)

        def add(doc: np.ndarray, values: np.ndarray) -> None:
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(doc, values[:, k], n_docs)
            np.add(seen, np.bincount(doc, minlength=n_docs), out=seen)

        lookup, logs = self.tables[0]
        hit, row = lookup.find(words.hashes)
        add(docs[hit], logs[row])
        rest = np.ones(len(docs), bool)
        rest[hit] = False
        rest = np.flatnonzero(rest)
        for n in LENGTHS:
            lookup, logs = self.tables[n]
            long = rest[words.stop[rest] - words.begin[rest] >= n]
            each = words.stop[long] - words.begin[long] - n + 1
            if not len(long):
                continue
            owner = np.repeat(np.arange(len(long)), each)
            at = words.begin[long][owner] + np.arange(len(owner)) - (np.cumsum(each) - each)[owner]
            hit, row = lookup.find(words.grams(at, n))
            known = np.bincount(owner[hit], minlength=len(long))
            some = np.flatnonzero(known)
            means = np.stack(
                [np.bincount(owner[hit], logs[row, k], len(long))[some] / known[some] for k in range(len(self.langs))], axis=1
            )
            add(docs[long[some]], means)
            done = np.zeros(len(docs), bool)
            done[long[some]] = True
            rest = rest[~done[rest]]
        return total, seen


def fit(
    docs: DataFrame,
    train: Column,
    sample_docs: int = SAMPLE_DOCS,
    entries: int | None = ENTRIES,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Fit on texts and languages of the rows that meet ``train``; ``entries=None`` keeps every word and n-gram of the sample.

    Null text or language: not learned from. Repeated rows and rows without an id: learned from like others
    (rows without one are sampled together). Ties in counts: the lesser hash. Empty table: a model without languages.
    """
    rows = docs.filter(train).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("key")
    )
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    picked = sampled(rows, "lang", F.col("key"), sample_docs).select("text", "lang")
    counts = (
        picked.mapInArrow(_count_batches, "lang string, n int, hash bigint, count bigint")
        .groupBy("lang", "n", "hash")
        .agg(F.sum("count").alias("count"))
    )
    kind = Window.partitionBy("lang", "n")
    if entries is not None:
        counts = counts.withColumn("place", F.row_number().over(kind.orderBy(F.desc("count"), "hash"))).filter(F.col("place") <= entries).drop("place")
    kept = counts.toPandas()
    totals = kept.groupby(["lang", "n"])["count"].sum().reset_index(name="total") if len(kept) else pd.DataFrame({"lang": [], "n": [], "total": []})
    return Model(kept, totals)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added (existing columns of these names are replaced).

    Null text or one without a letter: ``und``, score 0. Letters of which nothing
    is known: the first language in order, all being equally likely. Ties: the
    first language in order. Texts of any length: scored whole. Repeated rows and
    rows without an id: each is scored. Empty table: no rows. A model without
    languages: ``und`` for every row.
    """
    out = docs.drop("lang_pred", "score")
    schema = StructType([*out.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    place = out.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, place)):
            texts = texts_of(batch.column(place))
            pred, conf = [], []
            for a, z in chunks(texts):
                total, seen = model.scores(texts[a:z]) if model.langs else (None, None)
                for i, text in enumerate(texts[a:z]):
                    if total is None or not any(c.isalpha() for c in text):
                        pred.append(UNKNOWN)
                        conf.append(0.0)
                        continue
                    x = total[i] * (min(seen[i], EVIDENCE) / max(seen[i], 1.0))
                    best = int(np.argmax(x))
                    pred.append(model.langs[best])
                    conf.append(float(1.0 / np.exp(x - x[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(conf, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )
        release()

    return out.mapInArrow(score, schema)


def held_out(id_col: Column) -> Column:
    return bucket_of(id_col, 4) == 2


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out(F.col("doc_id")))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
