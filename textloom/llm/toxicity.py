"""Toxicity: a counterfactually regularised linear classifier.

Features of a text are its distinct words and the distinct beginnings of its
words (``PREFIXES`` characters). Features whose presence differs between the
classes by more than chance are kept, together with those of every identity term,
and a logistic regression is fitted on them in which both classes weigh alike. Each labelled text gives a
counterfactual pair: its identity terms are swapped for the next ones of their sets;
a text that names no group is given one (a term chosen by a hash of the text) and
compared with itself under the next term. The loss adds ``counterfactual * (change
of the text's log odds)**2``, so that which group is named does not move the score,
even where a term looks like words of toxic texts. ``Model.pairs`` counts the pairs.

The fit uses a bounded sample of labelled rows (``sample_rows`` of each class,
chosen by a hash of the id); its features leave the executors in one batch bounded
by it. Every document is then scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.langid import bucket_of, sampled
from textloom.llm.textvec import Lookup, Words, release, slices, texts_of
from textloom.session import cut, discard, table

SAMPLE_ROWS = 8_000
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.7
#: Chance level, as a z score, above which a feature is kept.
LEAST_Z = 5.0
COUNTERFACTUAL_WEIGHT = 4.0
#: Groups of terms that may stand for one another (fixed values of this operator).
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "trans", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("disabled", "blind", "deaf", "autistic"),
    ("frauen", "männer", "juden", "muslime", "christen"),
    ("femmes", "hommes", "juifs", "musulmans", "chrétiens"),
    ("mujeres", "hombres", "judíos", "musulmanes", "cristianos"),
)


_NEXT = {term: terms[(k + 1) % len(terms)] for terms in IDENTITY_TERMS for k, term in enumerate(terms)}
_TERMS = list(_NEXT)
_WORD = re.compile(r"[^\W_]+")


def features(texts: list[str], lookup: Lookup | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, feature hashes or, with ``lookup``, feature rows), distinct, sorted by text."""
    words = Words(texts)
    docs = words.doc_of_word()
    found_doc, found = [], []
    for n in (0, *PREFIXES):
        if n:
            long = np.flatnonzero(words.stop - words.begin >= n)
            doc, values = docs[long], words.grams(words.begin[long], n)
        else:
            doc, values = docs, words.hashes
        if lookup is not None:
            hit, row = lookup.find(values)
            doc, values = doc[hit], row.astype(np.uint64)
        found_doc.append(doc)
        found.append(values)
    doc, values = np.concatenate(found_doc), np.concatenate(found)
    if not len(doc):
        return doc, values
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    return doc[new], values[new]


def swap_terms(text: str) -> str | None:
    """The text in lower case with every identity term (a whole word) swapped; None if it has none."""
    text = text.lower()
    new = _WORD.sub(lambda m: _NEXT.get(m[0], m[0]), text)
    return None if new == text else new


def counterfactuals(texts: list[str]) -> tuple[list[str], list[str]]:
    """(texts that name a group, the same texts naming another); see the module."""
    ones, others = [], []
    for text in texts:
        other = swap_terms(text)
        if other is None:
            pick = _TERMS[zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(_TERMS)]
            text, other = f"{text} {pick}", f"{text} {_NEXT[pick]}"
        ones.append(text)
        others.append(other)
    return ones, others


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 0)):
        doc, values = features(texts_of(batch.column(0)))
        label = batch.column(1).to_numpy()[doc]
        hashes, row = np.unique(values, return_inverse=True)
        ones = np.bincount(row, label, len(hashes)).astype(np.int64)
        every = np.bincount(row, minlength=len(hashes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(every), pa.array(ones)], names=["hash", "n", "ones"])


def _by_text(doc: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    ends = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(row.astype(np.int32)))


class Model:
    """Weights of features and of the class as a whole."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float, pairs: int = 0):
        self.lookup, self.weights, self.bias, self.pairs = Lookup(hashes), weights, bias, pairs

    def scores(self, texts: list[str]) -> np.ndarray:
        doc, row = features(texts, self.lookup)
        z = np.bincount(doc, self.weights[row.astype(np.int64)], len(texts)) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def train_weights(
    doc: np.ndarray, row: np.ndarray, label: np.ndarray, weight: np.ndarray, n_features: int,
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
    counterfactual: float = COUNTERFACTUAL_WEIGHT, ridge: float = 1e-3, steps: int = 300,
) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated, diagonally scaled gradient steps.

    doc, row: the features present. pairs: (pair, row, sign) with +1 for features
    only of the text and -1 for those only of its counterfactual.
    """
    n_docs, total = len(label), weight.sum()
    w, b = np.zeros(n_features), 0.0
    vw, vb = w.copy(), b
    # curvature bound for each feature: a row's features share its second derivative of 1/4 at most
    size = np.bincount(doc, minlength=n_docs) + 1.0
    scale = np.bincount(row, (weight * size)[doc], n_features) / (4 * total) + ridge
    scale_b = (weight * size).sum() / (4 * total)
    if pairs is not None and len(pairs[0]):
        n_pairs = pairs[0].max() + 1
        width = np.bincount(pairs[0], minlength=n_pairs)
        scale += 2 * counterfactual * np.bincount(pairs[1], width[pairs[0]], n_features) / n_pairs
    for t in range(steps):
        z = np.bincount(doc, vw[row], n_docs) + vb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label) / total
        gw, gb = np.bincount(row, g[doc], n_features) + ridge * vw, g.sum()
        if pairs is not None and len(pairs[0]):
            gap = np.bincount(pairs[0], pairs[2] * vw[pairs[1]], n_pairs)
            gw += 2 * counterfactual * np.bincount(pairs[1], pairs[2] * gap[pairs[0]], n_features) / n_pairs
        w2, b2 = vw - gw / scale, vb - gb / scale_b
        k = t / (t + 3)
        vw, vb = w2 + k * (w2 - w), b2 + k * (b2 - b)
        w, b = w2, b2
    return w, float(b)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    sample_rows: int = SAMPLE_ROWS,
    counterfactual: float = COUNTERFACTUAL_WEIGHT,
) -> Model:
    """Fit on the labelled rows that meet ``train`` (over doc_id).

    No labels of a class, or an empty table: a constant score. Null label or id: not
    used. An id labelled twice is toxic if any label says so; one that several rows
    of ``docs`` have stands for the least of their texts. Null text: empty.
    """
    known = labels.filter(train).filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
    known = known.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 3.0 if 1 in sizes else -3.0)
    # of a proven size: sample_rows of each of two classes at most (a hash share of the class)
    picked = sampled(known, "toxic", F.col("doc_id"), sample_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    texts = cut(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"))
    counts = (
        texts.mapInArrow(_count_batches, "hash bigint, n bigint, ones bigint")
        .groupBy("hash")
        .agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    )
    share = {k: min(1.0, sample_rows / n) for k, n in sizes.items()}
    rate = sizes[1] * share[1] / (sizes[0] * share[0] + sizes[1] * share[1])
    z = (F.col("ones") - F.col("n") * F.lit(rate)) / F.sqrt(F.col("n") * F.lit(rate * (1 - rate)))
    kept = counts.filter(F.abs(z) >= LEAST_Z).select("hash").toPandas()["hash"].to_numpy(np.int64).view(np.uint64)
    hashes = np.union1d(kept, features(_TERMS)[1])
    lookup = Lookup(hashes)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0)):
            of, n = texts_of(batch.column(0)), batch.num_rows
            lists = [_by_text(*features(x, lookup), n) for x in (of, *counterfactuals(of))]
            yield pa.RecordBatch.from_arrays([batch.column(1), *lists], names=["toxic", "rows", "named", "swapped"])

    data: pd.DataFrame = texts.mapInArrow(sparse, "toxic int, rows array<int>, named array<int>, swapped array<int>").toPandas()
    discard(texts)
    if not len(data):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -3.0)
    label = data["toxic"].to_numpy(float)
    lengths = data["rows"].map(len).to_numpy(np.int64)
    doc, row = np.repeat(np.arange(len(data)), lengths), np.concatenate([*data["rows"], np.zeros(0, np.int64)]).astype(np.int64)
    pair, prow, sign = [], [], []
    for k, (mine, other) in enumerate(zip(data["named"], data["swapped"], strict=True)):
        for values, s in ((np.setdiff1d(mine, other), 1.0), (np.setdiff1d(other, mine), -1.0)):
            pair.append(np.full(len(values), k))
            prow.append(values.astype(np.int64))
            sign.append(np.full(len(values), s))
    number = np.unique(np.concatenate(pair), return_inverse=True)[1]
    pairs = (number, np.concatenate(prow), np.concatenate(sign))
    weight = 1 / np.bincount(label.astype(np.int64), minlength=2).clip(1)[label.astype(np.int64)]  # the classes weigh alike
    weights, bias = train_weights(doc, row, label, weight, len(hashes), pairs, counterfactual)
    return Model(hashes, weights, bias, int(number.max(initial=-1)) + 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row of ``docs`` (doc_id, text).

    A null or empty text scores the bias alone. Texts of any length: scored whole.
    Repeated rows: each is scored. Null id: stays null. Empty table: no rows. Other
    columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            values = model.scores(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "score"])
        release()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def held_out(id_col: Column) -> Column:
    return bucket_of(id_col, 3) == 1


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out(F.col("doc_id")))
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
