"""Scoring documents by a language model that the corpus itself trains.

Tokens are the words of a text, ``A-Z`` lower-cased, and an end. Their exact counts
in all training texts are summed in Spark and stay there: a table of one row for
each word, however many there are. The model (``logbilinear``) tells apart
the ``WORDS`` most frequent tokens and ``CLASSES`` classes of all others, by the last two bytes;
inside a class a word has its share of the class's tokens, with 0.1 added for each word
and for one that was never seen, so the probabilities of all words sum to one.

It is trained on every training text: each task learns from the texts it reads, the
tasks' parameters are averaged by tokens and the next round starts from the average.
A round reads its own part of the texts, by a hash, so that all rounds are one pass.

Scoring reads each text once. Counts of the ``KNOWN`` most frequent words travel with the
model, a table of fixed size; a text's other words meet their counts in a join on the word.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.divergence import bucket
from textloom.llm.langid import bucket_of
from textloom.llm.logbilinear import LogBilinear
from textloom.llm.textvec import release, slices, texts_of
from textloom.session import cut, discard, table

WORDS = 64
CLASSES = 128
KNOWN = 1 << 17
ROUNDS = 2
#: Partial averages that reach the driver in a round; a model has about 6,000 numbers.
MERGES = 32
#: The end of a text; no word is empty.
END = b""
#: Longer words are named by a digest (with a space before it, which no word holds).
LONG = 64
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
#: Tokens that are learned from or scored at once.
CHUNK = 1 << 16
SMOOTH = 0.1


def tokens_of(text: str) -> list[bytes]:
    """The words of a text and its end. ``bytes`` knows no letters but A-Z and no spaces but 0x20 and 0x09-0x0D."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if found and max(map(len, found)) > LONG:
        found = [w if len(w) <= LONG else b" " + hashlib.sha256(w).digest() for w in found]
    found.append(END)
    return found


def _rows(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in (part for whole in batches for part in slices(whole, column)):
        yield batch, texts_of(batch.column(column))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])

    for _, texts in _rows(batches, 0):
        for text in texts:
            held.update(tokens_of(text))
        if len(held) > HELD:
            yield out()
            held = Counter()
    if held:
        yield out()
    del held
    release()


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """token (binary) and c: how often each token stands in the texts. Null texts are empty: an end alone."""
    return docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What the model tells apart, and the counts of the most frequent tokens.

    ``names`` maps the most frequent tokens, ``known`` at most and all of a range of counts
    or none, to rows of ``counts`` and ``ids``; the others' counts are in ranges up to ``rare_to``. Ids
    below ``words`` are tokens, the others classes. ``frequency`` and ``kinds`` are
    the tokens and distinct tokens of each id; n and v those of all.
    """

    def __init__(self, counts: DataFrame, words: int = WORDS, classes: int = CLASSES, known: int = KNOWN):
        ending = F.when(F.length("token") < 2, F.col("token")).otherwise(F.expr("substring(token, -2, 2)"))
        # a row for each two bytes at most
        endings = counts.groupBy(ending.alias("ending")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
        # tokens by ranges of counts, a thousand at most; those of the highest ranges are known, ``known`` at most
        ranges = counts.groupBy(bucket(F.col("c")).alias("bucket")).agg(F.count(F.lit(1)).alias("v")).collect()
        self.rare_to, held = 0, 0
        for r in sorted(ranges, reverse=True):
            held += r["v"]
            if held > known:
                self.rare_to = r["bucket"]
                break
        top = counts.filter(bucket(F.col("c")) > self.rare_to).toArrow().to_pydict()
        ends = sum(r["c"] for r in endings if bytes(r["ending"]) == END)
        listed = sorted(zip(top["token"], top["c"], strict=True), key=lambda x: (-x[1], x[0]))
        listed = [(END, ends)] + [(w, c) for w, c in listed if w != END]
        self.n, self.v = sum(r["c"] for r in endings), sum(r["v"] for r in endings)
        self.words, self.classes = words, classes
        rest = {bytes(r["ending"]): [r["c"], r["v"]] for r in endings}
        rest.setdefault(END, [0, 0])
        for w, c in listed[:words]:
            rest[w[-2:]][0] -= c
            rest[w[-2:]][1] -= c > 0
        best = sorted((e for e in rest if rest[e][0]), key=lambda e: (-rest[e][0], e))[: classes - 1]
        self.endings = {e: words + i for i, e in enumerate(best)}
        self.names = {w: i for i, (w, _) in enumerate(listed)}
        self.counts = np.array([c for _, c in listed], np.float64)
        self.ids = np.array([i if i < words else self.id_of_rare(w) for i, (w, _) in enumerate(listed)], np.int64)
        self.frequency, self.kinds = np.zeros(words + classes), np.zeros(words + classes)
        self.frequency[: len(listed[:words])] = self.counts[:words]
        for e, (c, v) in rest.items():
            self.frequency[self.id_of_rare(e)] += c
            self.kinds[self.id_of_rare(e)] += v

    def id_of_rare(self, word: bytes) -> int:
        return self.endings.get(word[-2:], self.words + self.classes - 1)

    def rows_and_ids(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(row in the table of frequent tokens or -1, id) of each token."""
        rows = np.fromiter(map(self.names.get, found, repeat(-1)), np.int64, len(found))
        ids = self.ids[rows]
        rare = np.flatnonzero(rows < 0)
        if len(rare):
            ids[rare] = [self.id_of_rare(found[k]) for k in rare.tolist()]
        return rows, ids


def model_of(vocabulary: Vocabulary) -> LogBilinear:
    return LogBilinear(vocabulary.frequency + SMOOTH)


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, text_col: str = "text") -> LogBilinear:
    """The model after one pass over all texts in ``rounds`` parts, averaged over tasks after each part."""
    model = model_of(vocabulary)
    texts = docs.select(F.col(text_col).alias("text"))
    for k in range(rounds):
        flat = model.parameters()

        def learn(batches, flat=flat, seed=k):
            mine, rng = model_of(vocabulary), np.random.default_rng(seed)
            mine.set_parameters(flat)
            learned, waiting, n = 0, [], 0
            for _, texts in _rows(batches, 0):
                for text in texts:
                    waiting.append(vocabulary.rows_and_ids(tokens_of(text))[1])
                    n += len(waiting[-1])
                    if n >= CHUNK:
                        mine.learn(waiting, rng)
                        learned, waiting, n = learned + n, [], 0
            mine.learn(waiting, rng)
            learned += n
            if learned:
                yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "tokens": [learned], "flat": [mine.parameters().tobytes()]})
            release()

        def merge(batches):
            total, tokens = 0.0, 0
            for batch in batches:
                for n, values in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    total, tokens = total + n * np.frombuffer(values, np.float32).astype(np.float64), tokens + n
            if tokens:
                yield pa.RecordBatch.from_pydict({"tokens": [tokens], "flat": [total.tobytes()]})

        part = texts.filter(F.pmod(F.xxhash64(F.lit("round"), "text"), F.lit(rounds)) == k)
        learned = part.mapInArrow(learn, "part bigint, tokens bigint, flat binary").repartition(MERGES, "part").sortWithinPartitions("part")
        sums = learned.mapInArrow(merge, "tokens bigint, flat binary").coalesce(MERGES).collect()
        if sums:
            flat = sum(np.frombuffer(r["flat"], np.float64) for r in sums) / sum(r["tokens"] for r in sums)
            model.set_parameters(flat.astype(np.float32))
    return model


_SCORED = (
    "key bigint, doc_id {id}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, "
    "rare array<struct<token: binary, times: bigint>>"
)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, classes: int = CLASSES, known: int = KNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from rows that are not ``held_out``.

    n_known: tokens that training texts hold; train_tokens: all tokens of training texts.
    base_score: log10 probability by smoothed counts; score: by the model.

    Null or empty text: an end alone. Very long words and texts: scored whole. Repeated rows,
    rows without an id: each is scored, and each counts in training. Equal counts: by
    token, bytewise. Other columns, of any names, are not looked at. Nothing to learn from:
    the model as it begins, every token alike within its class. Empty table: no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    learned_from = rows.filter(~F.col("held_out"))
    counts = cut(token_counts(learned_from))
    vocabulary = Vocabulary(counts, words, classes, known)
    model = train(learned_from, vocabulary)
    all_counts, log_v = np.log10(vocabulary.counts + SMOOTH), float(np.log10(vocabulary.n + SMOOTH * (vocabulary.v + 1)))
    inside = np.log10(vocabulary.frequency + SMOOTH * (vocabulary.kinds + 1))
    inside[:words] = 0

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch, texts in _rows(batches, 2):
            start, n = 0, 0
            waiting: list[list[bytes]] = []
            for k, text in enumerate(texts):
                waiting.append(tokens_of(text))
                n += len(waiting[-1])
                if n >= CHUNK or k == len(texts) - 1:
                    yield _score_chunk(batch.slice(start, len(waiting)), waiting, key)
                    key += len(waiting)
                    start, waiting, n = k + 1, [], 0
        release()

    def _score_chunk(batch: pa.RecordBatch, found: list[list[bytes]], key: int) -> pa.RecordBatch:
        at = [vocabulary.rows_and_ids(w) for w in found]
        lengths = np.array([len(w) for w in found])
        owner = np.repeat(np.arange(len(found)), lengths)
        row, ids = np.concatenate([r for r, _ in at]), np.concatenate([i for _, i in at])
        own = np.where(row >= 0, all_counts[row], 0.0)  # of words beyond the table: added after the join
        by_model = model.log_probabilities([i for _, i in at]) / np.log(10.0) - inside[ids] + np.where(ids < words, 0.0, own)
        seen = (row >= 0) & (vocabulary.counts[row] > 0)
        n = len(found)
        rare = [[{"token": t, "times": c} for t, c in Counter([w[k] for k in np.flatnonzero(r < 0).tolist()]).items()] for w, (r, _) in zip(found, at, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(key, key + n)),
                batch.column(0),
                batch.column(1),
                pa.array(lengths.astype(np.int64)),
                pa.array(np.bincount(owner[seen], minlength=n).astype(np.int64)),
                pa.array(np.bincount(owner, own, n) - lengths * log_v),
                pa.array(np.bincount(owner, by_model, n)),
                pa.array(rare, pa.list_(pa.struct([("token", pa.binary()), ("times", pa.int64())]))),
            ],
            names=["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"],
        )

    first = cut(rows.mapInArrow(scored, _SCORED.format(id=rows.schema["doc_id"].dataType.simpleString())))
    rest = counts.filter(bucket(F.col("c")) <= vocabulary.rare_to)
    rare = first.select("key", F.explode("rare").alias("r")).select("key", F.col("r.token").alias("token"), F.col("r.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    added = (
        rare.join(rest, "token", "left")
        .groupBy("key")
        .agg(F.sum(F.col("times") * F.log10(c + SMOOTH)).alias("logs"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"))
    )
    out = cut(
        first.drop("rare").join(added, "key", "left").select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
            F.lit(int(vocabulary.n)).cast("bigint").alias("train_tokens"),
            (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
            (F.col("score") + F.coalesce("logs", F.lit(0.0))).alias("score"),
        )
    )
    discard(first, counts)
    return out


def op13_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, bucket_of(F.col("doc_id"), 10) == 0)
