"""MinHash fingerprints of documents, and matches between them.

A fingerprint holds, for each of ``PERMUTATIONS`` universal hash permutations, the
least value over the text's shingles of five words (16 bits of it), as hexadecimal
text. The share of equal components estimates the Jaccard similarity of the
shingle sets. ``fingerprint_matches`` joins bands of the signatures in Spark and
verifies the Jaccard similarity of what meets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.textvec import SHINGLE, Words, chunks, release, shingles, texts_of
from textloom.session import cut, table

PERMUTATIONS = 128
_EMPTY = 0xFFFF


def permutations(n: int = PERMUTATIONS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def signatures(texts: list[str], n: int = PERMUTATIONS, k: int = SHINGLE) -> np.ndarray:
    """One row of ``n`` uint16 components for each text; all ones for a text without words."""
    out = np.full((len(texts), n), _EMPTY, np.uint16)
    multiply, add = permutations(n)
    for a, z in chunks(texts, 1 << 18):
        words = Words(texts[a:z])
        hashes, offsets = shingles(words.hashes, words.first, k)
        some = np.flatnonzero(np.diff(offsets))
        if not len(some):
            continue
        x, at = (hashes >> np.uint64(32)).astype(np.uint32), offsets[some]
        for j in range(n):
            least = np.minimum.reduceat(x * multiply[j] + add[j], at)
            # the low bits of the least value: its high bits are small for long texts
            out[a + some, j] = (least & np.uint32(0xFFFF)) ^ (least >> np.uint32(16))
    return out


def to_bytes(signature: np.ndarray) -> bytes:
    return signature.astype(">u2").tobytes()


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many code points from the start of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_FIELDS = [
    ("doc_id", pa.int64()),
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()),
    ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
]
_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], own: np.ndarray, following: list[str], theirs: np.ndarray) -> list[pa.Array]:
    new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    sig = signatures(new)
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
        pa.array([to_bytes(s) for s in own], pa.binary()),
        pa.array([to_bytes(s) for s in sig], pa.binary()),
        pa.array((own == sig).mean(axis=1) if len(own) else [], pa.float64()),
        pa.array((own == theirs).mean(axis=1) if len(own) else [], pa.float64()),
    ]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: all but a partition's last are finished; its first and last row are handed on."""
    partition = TaskContext.get().partitionId()
    carried: tuple | None = None

    def edge(kind: str, doc_id, text: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*[pa.array([None], t) for _, t in _FIELDS], pa.array([kind]), pa.array([partition], pa.int32()), pa.array([doc_id], pa.int64()), pa.array([text])],
            names=[*[n for n, _ in _FIELDS], "kind", "partition", "edge_id", "edge_text"],
        )

    for batch in batches:
        all_ids, all_texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
        for a, z in chunks(all_texts):
            ids, texts = all_ids[a:z], all_texts[a:z]
            sig = signatures(texts)
            if carried is None:
                yield edge("first", ids[0], texts[0])
            else:
                ids, texts, sig = [carried[0], *ids], [carried[1], *texts], np.concatenate((carried[2], sig))
            carried = (ids[-1], texts[-1], sig[-1:])
            if len(ids) > 1:
                done = _rows(ids[:-1], texts[:-1], sig[:-1], texts[1:], sig[1:])
                n = len(ids) - 1
                yield pa.RecordBatch.from_arrays(
                    [*done, pa.array(["row"] * n), pa.array([partition] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())],
                    names=[*[x for x, _ in _FIELDS], "kind", "partition", "edge_id", "edge_text"],
                )
    if carried is not None:
        yield edge("last", carried[0], carried[1])
    release()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, following = batch.column(0).to_pylist(), texts_of(batch.column(1)), texts_of(batch.column(2))
        yield pa.RecordBatch.from_arrays(
            _rows(ids, texts, signatures(texts), following, signatures(following)), names=[n for n, _ in _FIELDS]
        )


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprint every text (doc_id, text) and its edited text; see the module.

    Documents follow one another by descending doc_id, null ids last, equal ids by
    text; the first follows the last. Texts are shuffled once, by ranges of doc_id;
    a partition finishes every row but its last, whose successor is the first row of
    the next partition: two rows of each partition are joined afterwards.

    Null text: empty. A text without words: a fingerprint of its own, alike for all
    such texts. A single document follows itself. Repeated rows: each has a row.
    Empty table: no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    # ranges of ids alone: the bounds are sampled, and texts must not be
    ordered = rows.repartitionByRange(n, F.desc_nulls_last("doc_id")).sortWithinPartitions(F.desc_nulls_last("doc_id"), "text")
    kept = cut(ordered.mapInArrow(_in_order, _SCHEMA + ", kind string, partition int, edge_id bigint, edge_text string"))
    firsts = kept.filter("kind = 'first'").select("partition", F.col("edge_text").alias("text"))
    lasts = kept.filter("kind = 'last'").select("partition", F.col("edge_id").alias("doc_id"), "edge_text")
    # one row for each partition; the first follows the last
    numbers = Window.orderBy("partition")
    size = firsts.count()
    firsts = firsts.withColumn("at", F.pmod(F.row_number().over(numbers) - 2, F.lit(max(size, 1))))
    lasts = lasts.withColumn("at", F.pmod(F.row_number().over(numbers) - 1, F.lit(max(size, 1))))
    ends = lasts.join(firsts.select("at", "text"), "at").select("doc_id", F.col("edge_text").alias("own"), "text")
    done = kept.filter("kind = 'row'").select(*[n for n, _ in _FIELDS]).unionByName(ends.mapInArrow(_pairs, _SCHEMA))
    return done.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def fingerprint_matches(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id): documents joined by bands of their signatures, Jaccard verified on the shingle sets.

    Odd rows are as in ``near_duplicates``: texts without words are like equal ones
    only, null text is empty, rows without an id take part, repeated rows each have a
    row, rows that share an id have the class of their own text. Empty table: no rows.
    """
    from textloom.llm.neardup import near_duplicates

    # 32 bands of 4 components: a pair at 0.8 shares none once in 20 million
    return near_duplicates(docs, threshold, signatures, 32, 4, weighted=False)


def op8_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
