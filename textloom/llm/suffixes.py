"""Passages repeated across documents, by sparse suffix arrays.

Only suffixes that start at content-selected positions are retained: the
minimisers of runs of ``GRAM`` words in windows of ``WINDOW`` such runs. Texts that
share ``GRAM + WINDOW - 1`` = 50 words select the same positions in them. Suffixes
whose first ``GRAM`` words occur in one text alone are dropped early; the others
carry the words around them and are sorted by the words that follow, then by those
before, and the other way round. Each is compared with its nearest neighbours from
other texts in both orders, and the match is extended to the right and to the left.
Matches of 50 words or more cover parts of both texts; overlapping parts are merged.

Coverage is exact. The two orders give the farthest match to the right and that to
the left of a suffix; where both belong to matches of 50 words, nothing can reach
further. The suffixes of all other grams, and of those that more than ``HOT``
suffixes share, are compared by their windows of exactly 50 words: one row for each
window, pre-aggregated before the shuffle, so a passage that a third of all texts
share meets in no single task. Suffixes are dealt by a hash of their gram.

Texts are named by a digest, so rows need no ids to take part, and equal texts are
one text until the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.pick import pick
from textloom.llm.textvec import Words, mix, one_of_each, powers, release, slices, texts_of
from textloom.session import cut, discard, table

LEAST_WORDS = 50
GRAM = 16
WINDOW = LEAST_WORDS - GRAM + 1
#: Words before the position, and after its first GRAM words, that a suffix carries: all that a run of 50 can reach.
AROUND = WINDOW - 1
#: Suffixes sorted by one task.
SORTED_ROWS = 20_000
#: Suffixes of a gram above which they are compared by windows.
HOT = 2_000


def minimisers(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word positions, gram hashes) of the minimisers; positions count from the chunk's first word.

    Of equal grams in a row (a repeated word) every WINDOW-th is taken.
    """
    n = len(hashes)
    if n < LEAST_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = np.zeros(n - GRAM + 1, np.uint64)
    for j in range(GRAM):
        gram = mix(gram * np.uint64(3) + hashes[j : j + len(gram)])
    # sliding minimum by doubling
    low, size = gram, 1
    while size * 2 <= WINDOW:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    rest = WINDOW - size
    low = np.minimum(low[: len(low) - rest], low[rest:])
    # windows that lie in one text
    starts = np.arange(len(low))
    text = np.searchsorted(first, starts, side="right") - 1
    whole = starts + LEAST_WORDS <= first[text + 1]
    starts, low = starts[whole], low[whole]
    taken = np.zeros(len(gram), bool)
    for j in range(WINDOW):
        taken[starts[gram[starts + j] == low] + j] = True
    same = np.zeros(len(gram), bool)
    same[1:] = gram[1:] == gram[:-1]
    if same.any():
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(gram))))
        taken &= (np.arange(len(gram)) - head) % WINDOW == 0
    at = np.flatnonzero(taken)
    return at, gram[at]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every retained position and its gram; one more row for each text has its number of words and no gram."""
    for whole in batches:
        for batch in slices(one_of_each(whole, 1, 0), 2):
            rep, ids, texts = batch.column(0), batch.column(1).to_numpy(), texts_of(batch.column(2))
            words = Words(texts, lower=False)
            at, gram = minimisers(words.hashes, words.first)
            doc = np.searchsorted(words.first, at, side="right") - 1
            place, n = (at - words.first[doc]).astype(np.int32), words.counts.astype(np.int32)
            of = np.concatenate((doc, np.arange(len(texts))))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[of]),
                    rep.take(pa.array(of)),
                    pa.array(np.concatenate((place, n))),
                    pa.concat_arrays([pa.array(gram.view(np.int64)), pa.nulls(len(texts), pa.int64())]),
                ],
                names=["v", "rep", "at", "gram"],
            )
    release()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words after (32 bits each) and before (nearest first) every retained position."""
    offsets = np.concatenate((GRAM + np.arange(AROUND), -1 - np.arange(AROUND)))
    for batch in (part for whole in batches for part in slices(whole, 1)):
        ids, texts = batch.column(0).to_numpy(), texts_of(batch.column(1))
        words = Words(texts, lower=False)
        short = (words.hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        doc, at, gram = _places(batch.column(2), batch.column(3))
        where = at[:, None] + offsets[None, :]
        inside = (where >= 0) & (where < words.counts[doc][:, None])
        where = np.where(inside, where + words.first[doc][:, None], 0)
        around = np.where(inside, short[where], np.uint32(0)).astype(">u4")
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[doc]), pa.array(at.astype(np.int32)), pa.array(gram), pa.array([x.tobytes() for x in around], pa.binary())],
            names=["v", "at", "gram", "around"],
        )
    release()


def _places(at: pa.Array, gram: pa.Array | None = None) -> tuple[np.ndarray, ...]:
    """(row, position, gram) of each position of a batch's lists."""
    n = at.value_lengths().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(at)), n)
    return doc, at.flatten().to_numpy().astype(np.int64), gram.flatten().to_numpy() if gram is not None else None


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, start, key) of every run of 50 words that holds one of the positions and its gram."""
    for batch in (part for whole in batches for part in slices(whole, 1)):
        ids, words = batch.column(0).to_numpy(), Words(texts_of(batch.column(1)), lower=False)
        up, down = powers(len(words.hashes) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.hashes * up[:-1], dtype=np.uint64)))
        doc, at, _ = _places(batch.column(2))
        start = at[:, None] - np.arange(WINDOW)[None, :]
        inside = (start >= 0) & (start + LEAST_WORDS <= words.counts[doc][:, None])
        start = np.unique((start + words.first[doc][:, None])[inside])
        doc = np.searchsorted(words.first, start, side="right") - 1
        key = mix((sums[start + LEAST_WORDS] - sums[start]) * down[start])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[doc]), pa.array((start - words.first[doc]).astype(np.int32)), pa.array(key.view(np.int64))],
            names=["v", "start", "key"],
        )
    release()


def nearest(v: np.ndarray, gram: np.ndarray, around: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For sorted rows: (row, nearest row of another text before or after it with the same gram, first, second).

    first: words that agree from the start of ``around``; second: from its middle.
    """
    n = len(v)
    run = np.concatenate(([True], (v[1:] != v[:-1]) | (gram[1:] != gram[:-1])))
    begin = np.maximum.accumulate(np.where(run, np.arange(n), 0))
    heads = np.append(np.flatnonzero(run), n)
    for other in (begin - 1, heads[np.cumsum(run)]):
        mine = np.flatnonzero((other >= 0) & (other < n))
        mine = mine[gram[mine] == gram[other[mine]]]
        for a in range(0, len(mine), 1 << 15):
            m = mine[a : a + (1 << 15)]
            equal = (around[m] == around[other[m]]) & (around[m] != 0)
            yield m, other[m], *(np.cumprod(equal[:, k : k + AROUND], axis=1).sum(axis=1) for k in (0, AROUND))


def compare(v: np.ndarray, at: np.ndarray, gram: np.ndarray, around: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Matches (v, start, stop, other) of rows with their neighbours in both orders, and the grams that these do not settle."""
    found, far, long = [], np.zeros((2, len(v)), np.int64), np.zeros((2, len(v)), np.int64)
    for side in (0, 1):
        turned = around if side == 0 else np.roll(around, AROUND, axis=1)
        raw = np.ascontiguousarray(turned.astype(">u4")).view(f"S{8 * AROUND}").ravel()
        order = np.lexsort((at, v, raw, gram))
        for m, other, first, second in nearest(v[order], gram[order], turned[order]):
            m, other = order[m], order[other]
            right, left = (first, second) if side == 0 else (second, first)
            enough = left + GRAM + right >= LEAST_WORDS
            found.append((v[m][enough], (at[m] - left)[enough], (at[m] + GRAM + right)[enough], v[other][enough]))
            np.maximum.at(far[side], m, first)
            np.maximum.at(long[side], m[enough], first[enough] + 1)
    # the farthest matches to the right and to the left are both of 50 words, or nothing of 50 words can be
    settled = (far.sum(axis=0) + GRAM < LEAST_WORDS) | ((long[0] == far[0] + 1) & (long[1] == far[1] + 1))
    return tuple(np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(4)), np.unique(gram[~settled])


_MATCH = "v bigint, start int, stop int, other bigint"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of a task's suffixes; rows that name a gram alone are not settled by them. A gram stays in one part."""
    parts: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        # rows come by gram: all but the last gram of a batch are whole
        gram = batch.column(2).to_numpy()
        first = int(np.searchsorted(gram, gram[-1])) if len(gram) else 0
        if held + first >= SORTED_ROWS and first:
            yield _compared([*parts, batch.slice(0, first)])
            parts, held = [], 0
            batch = batch.slice(first)
        parts.append(batch)
        held += batch.num_rows
    if held:
        yield _compared(parts)
    release()


def _compared(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(parts)
    v, at, gram = (whole.column(x).to_numpy() for x in ("v", "at", "gram"))
    around = np.frombuffer(b"".join(whole.column("around").to_pylist()), ">u4").reshape(len(v), 2 * AROUND).astype(np.uint32)
    (v, start, stop, other), open_grams = compare(v, at.astype(np.int64), gram, around)
    n, m = len(v), len(open_grams)
    columns = [pa.array(v), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(other)]
    columns = [pa.concat_arrays([x, pa.nulls(m, x.type)]) for x in columns]
    return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(open_grams)])], names=["v", "start", "stop", "other", "gram"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of 50 words or more that another document has as well.

    Returns doc_id, start_word, end_word (words are runs of letters and digits,
    counted from 0; end exclusive), other_id (a document that shares some of it; the
    least doc_id of its text, null if its rows have no id) and copies (rows of the
    same text). Case counts, punctuation does not. Spans of a document do not overlap.

    A text that occurs in several rows and has 50 words is one span. A passage
    repeated inside one document alone is not reported. Null or short text: no span.
    Null doc_id: searched and compared like any other, but only rows with an id are
    returned. Repeated rows: copies of one text, one row for each span. A repeated id
    with unlike texts: the spans of each. Empty table: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    v = F.xxhash64(F.md5(text.cast("binary")))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), v.alias("v"), text.alias("text"))
    ids = cut(rows.select("doc_id", "v"))
    firsts = ids.groupBy("v").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    marks = cut(rows.mapInArrow(_anchors, "v bigint, rep bigint, at int, gram bigint"))
    anchors = marks.filter("gram IS NOT NULL")
    by_gram = anchors.groupBy("gram").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    shared = cut(by_gram.filter("low < high").select("gram", (F.col("n") > HOT).alias("hot")))
    places = F.collect_set(F.struct("at", "gram", "hot")).alias("places")
    kept = cut(anchors.join(shared, "gram").groupBy("v").agg(F.min("rep").alias("rep"), places).select(F.col("v").alias("of"), "rep", "places"))

    def with_text(of: DataFrame, *columns) -> DataFrame:
        """The one row of each text, with these columns of ``of`` (of, rep, ...)."""
        return pick(rows, of).select("v", "text", *columns)

    n_rows = kept.agg(F.coalesce(F.sum(F.size(F.filter("places", lambda x: ~x["hot"]))), F.lit(0))).first()[0]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // SORTED_ROWS))
    cool = kept.withColumn("cool", F.filter("places", lambda x: ~x["hot"])).filter(F.size("cool") > 0)
    suffixes = with_text(cool, F.col("cool.at").alias("at"), F.col("cool.gram").alias("gram"))
    compared = cut(
        suffixes.mapInArrow(_contexts, "v bigint, at int, gram bigint, around binary")
        .repartition(n, "gram")
        .sortWithinPartitions("gram")
        .mapInArrow(_neighbours, _MATCH + ", gram bigint")
    )
    unsettled = compared.filter("gram IS NOT NULL").select(F.col("gram").alias("open")).distinct()
    placed = kept.select("of", "rep", F.explode("places").alias("place")).select("of", "rep", "place.at", "place.gram", "place.hot")
    opened = placed.join(unsettled, F.col("gram") == F.col("open"), "left").filter("hot OR open IS NOT NULL")
    opened = opened.groupBy("of", "rep").agg(F.collect_list("at").alias("at"))
    windows = cut(with_text(opened, "at").mapInArrow(_windows, "v bigint, start int, key bigint"))
    # written first, so that the join below is free to split the windows of a frequent passage
    common = cut(windows.groupBy("key").agg(F.min("v").alias("low"), F.max("v").alias("high")).filter("low < high"))
    other = F.when(F.col("v") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    exact = windows.join(common, "key").select("v", "start", (F.col("start") + LEAST_WORDS).alias("stop"), other.alias("other"))
    matches = compared.filter("gram IS NULL").select("v", "start", "stop", "other").unionByName(exact)
    by_start = Window.partitionBy("v").orderBy("start", "stop")
    reached = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    islands = matches.withColumn("new", F.when(F.col("start") <= reached, 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    spans = cut(islands.groupBy("v", "island").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("other").alias("other")).drop("island"))

    copied = cut(firsts.filter("copies > 1"))
    named = ids.filter("doc_id IS NOT NULL").distinct()
    others = firsts.select(F.col("v").alias("other"), F.col("first").alias("other_id"))
    single = spans.join(copied.select("v"), "v", "left_anti").join(others, "other").join(named, "v")
    alone = single.select("doc_id", "start_word", "end_word", "other_id", F.lit(1).cast("bigint").alias("copies"))
    lengths = marks.filter("gram IS NULL").select("v", F.col("at").alias("end_word")).distinct().filter(F.col("end_word") >= LEAST_WORDS)
    copies = named.join(copied.join(lengths, "v"), "v").select("doc_id", F.lit(0).alias("start_word"), "end_word", F.col("first").alias("other_id"), "copies")
    out = cut(alone.unionByName(copies))
    discard(ids, marks, shared, kept, compared, windows, common, spans, copied)
    return out


def op6_suffix_passages(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))
