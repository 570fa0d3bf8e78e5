"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents longer than a sequence are cut into whole sequences and a last piece.
The last pieces and the shorter documents are packed by bulk-synchronous best fit:

1. items and gaps (the free ends of sequences) are dealt out by ranges of size;
2. in every range, at the same time, a successor sweep from the largest size down
   offers each item the smallest free gap it fits in; where items of a size compete
   for gaps, their rank decides. What a range could not match (items that need the
   gap of a larger range, gaps that no item of the range took) meets in a last sweep;
3. gaps are updated, and the sweeps repeat until no item fits a gap; then new
   sequences are opened for what is left.

A length is an integer of at most ``capacity``, so items of equal length, like
gaps of equal size, are interchangeable: the rows of a sweep are lots (size, first
rank, how many), a few for each size however large the corpus. The rest stays by
row: tokenizing, ranking the items of each length (by hash buckets, no length's
items meet in one task) and the join with the places found.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.sharding import hex_digits
from textloom.llm.textvec import release, slices, texts_of
from textloom.llm.wordbpe import WordTokenizer
from textloom.session import cut, discard, table

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
#: Items shorter than this are first bundled with others of their length, which bounds the sweeps.
BUNDLE = 128
#: Bytes of text tokenized at once.
TOKENIZED = 1 << 18
#: Ranges of sizes that are swept at the same time.
RANGES = 8
#: Rounds of sweeps in one Spark job.
ROUNDS = 4


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (tells repeated ids apart), piece, start, length, ids_crc32 of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokenizer(path)
        for batch in batches:
            for part in slices(batch, 1, TOKENIZED):
                out: list[tuple] = []
                for doc_id, tokens in zip(part.column(0).to_pylist(), encode(texts_of(part.column(1))), strict=True):
                    raw = tokens.astype("<u4")
                    for k, at in enumerate(range(0, len(raw), capacity)):
                        piece = raw[at : at + capacity]
                        out.append((doc_id, k, at, len(piece), zlib.crc32(piece.tobytes())))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        del encode
        release()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def sweep(items: list[list[int]], gaps: list[list[int]]) -> tuple[list, list, list]:
    """One best-fit round over classes, at most one item for each gap.

    items: [length, first number, count], gaps: [size, first sequence, count].
    Going from the largest size down, gaps are laid on a stack; an item takes the
    gap on top, the smallest of those it fits in. Returns (placed, items left,
    gaps left), placed: [length, first number, count, first sequence, size].
    """
    placed, left, stack = [], [], []
    gaps = sorted(gaps)
    for length, number, count in sorted(items, reverse=True):
        while gaps and gaps[-1][0] >= length:
            stack.append(list(gaps.pop()))
        while count and stack:
            size, sequence, free = stack[-1]
            n = min(count, free)
            placed.append([length, number, n, sequence, size])
            number, count = number + n, count - n
            if n == free:
                stack.pop()
            else:
                stack[-1][1:] = [sequence + n, free - n]
        if count:
            left.append([length, number, count])
    return placed, left, stack + gaps


#: A lot of items, of gaps, or of items placed in gaps; the last kind counts the sequences opened so far.
ITEM, GAP, PLACED, OPENED = range(4)
_LOT = "kind int, size bigint, first bigint, n bigint, sequence bigint, gap bigint, fresh boolean"
_COLUMNS = [x.split()[0] for x in _LOT.split(", ")]


def _swept(lots: pd.DataFrame) -> pd.DataFrame:
    """The lots of a range (or what all ranges left) after one sweep; placed lots of this round are fresh."""
    waiting = lots["kind"] <= GAP
    items = lots[lots["kind"] == ITEM][["size", "first", "n"]].to_numpy().tolist()
    gaps = lots[lots["kind"] == GAP][["size", "first", "n"]].to_numpy().tolist()
    placed, items, gaps = sweep(items, gaps)
    rows = [(ITEM, *x, 0, 0, False) for x in items] + [(GAP, *x, 0, 0, False) for x in gaps]
    rows += [(PLACED, *x, True) for x in placed]
    return pd.concat([lots[~waiting][_COLUMNS], pd.DataFrame(rows, columns=_COLUMNS)])


def _round_end(capacity: int):
    def run(lots: pd.DataFrame) -> pd.DataFrame:
        """Match what the ranges left, cut the taken gaps, open new sequences if nothing was placed."""
        lots = _swept(lots)
        opened = int(lots[lots["kind"] == OPENED]["n"].sum())
        fresh = lots[lots["fresh"]]
        items = lots[lots["kind"] == ITEM]
        rows = []
        if len(fresh):
            over = fresh[fresh["gap"] > fresh["size"]]
            rows = [(GAP, gap - size, sequence, n, 0, 0, False) for size, n, sequence, gap in over[["size", "n", "sequence", "gap"]].to_numpy().tolist()]
        elif len(items):
            more = max(1, -(-int((items["size"] * items["n"]).sum()) // capacity))
            rows = [(GAP, capacity, opened, more, 0, 0, False)]
            opened += more
        kept = lots[lots["kind"] != OPENED].assign(fresh=False)
        rows.append((OPENED, 0, 0, opened, 0, 0, False))
        return pd.concat([kept[_COLUMNS], pd.DataFrame(rows, columns=_COLUMNS)])

    return run


def _all_at_once(use):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield use(pd.concat([pd.DataFrame(columns=_COLUMNS), *batches]).astype({c: "int64" for c in _COLUMNS[:-1]} | {"fresh": bool}))

    return run


def placed_lots(spark: SparkSession, items: list[list[int]], capacity: int = CAPACITY) -> list[list[int]]:
    """Places of all items: [size, first number, count, first sequence, gap] for each lot; see the module.

    items: one lot [size, first number, count] for each size. Only whether items
    wait reaches the driver between jobs.
    """
    if not items:
        return []
    rows = [(ITEM, *x, 0, 0, False) for x in items]
    lots = spark.createDataFrame(pd.DataFrame(rows, columns=_COLUMNS), _LOT)
    width = F.lit(-(-(capacity + 1) // RANGES))
    # what is placed already only passes through, by any range
    of = F.when(F.col("kind") <= GAP, F.floor(F.col("size") / width)).otherwise(F.pmod("first", F.lit(RANGES)))
    done = []
    while True:
        for _ in range(ROUNDS):
            swept = lots.withColumn("range", of).groupBy("range").applyInPandas(_swept, _LOT)
            lots = swept.repartition(1).mapInPandas(_all_at_once(_round_end(capacity)), _LOT)  # a few lots for each size
        lots = cut(lots)
        done.append(lots)
        if lots.filter(F.col("kind") == ITEM).isEmpty():
            break
        lots = lots.filter(F.col("kind") != PLACED)
    placed = [lots.filter(F.col("kind") == PLACED).select("size", "first", "n", "sequence", "gap").toPandas() for lots in done]
    discard(*done)
    return pd.concat(placed).to_numpy().tolist()


def best_fit(spark: SparkSession, histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first number, count, first sequence, offset, step) placing every item.

    ``step`` items of a run follow one another in each sequence (bundles of short
    items). Bounded by the number of lengths, not of items.
    """
    # one class for each size: (length, step, first number, bundles) side by side in a list of numbers
    classes: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, count in histogram.items():
        n = max(1, min(BUNDLE, capacity // 2) // length)
        whole = count // n if n > 1 else 0
        rest = count - whole * n
        if whole:
            classes.setdefault(length * n, []).append((length, n, 0, whole))
        if rest:
            classes.setdefault(length, []).append((length, 1, whole * n, rest))
    runs = []
    for size, number, n, sequence, gap in placed_lots(spark, [[size, 0, sum(x[3] for x in found)] for size, found in classes.items()], capacity):
        at = 0
        for length, step, first, count in classes[size]:
            low, high = max(number, at), min(number + n, at + count)
            if low < high:
                runs.append((length, first + (low - at) * step, (high - low) * step, sequence + low - number, capacity - gap, step))
            at += count
    return runs


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place: sequence_id and offset (gapless from 0).

    Null text: empty, the end id alone. Repeated rows: each is packed. Null doc_id:
    packed like any other. Texts of any length: cut into whole sequences and a rest.
    Ties: items of a length are numbered by a hash of their ids. Empty table: no rows.
    """
    found = cut(pieces(docs, path, capacity, id_col, text_col))
    spark = docs.sparkSession
    # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = histogram.pop(capacity, 0)
    runs = best_fit(spark, histogram, capacity)
    if full:
        sequences = max([s + -(-n // step) for _, _, n, s, _, step in runs], default=0)
        runs.append((capacity, 0, full, sequences, 0, 1))
    runs_df = spark.createDataFrame(
        pd.DataFrame(runs, columns=["length", "first", "n", "sequence", "offset", "step"], dtype="int64"),
        "length bigint, first bigint, n bigint, sequence bigint, offset bigint, step bigint",
    )
    order = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("piece").cast("string"), F.col("ids_crc32").cast("string")).cast("binary"))
    digits = hex_digits(sum(histogram.values()) + full)
    keyed = found.withColumn("order", order).withColumn("part", F.substring("order", 1, digits))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("length", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "part").orderBy("order", "start")
    numbered = (
        keyed.withColumn("nth", F.row_number().over(within) - 1)
        .join(offsets, ["length", "part"])
        .withColumn("number", F.col("before") + F.col("nth"))
    )
    by_length = runs_df.groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("first", "n", "sequence", "offset", "step"))).alias("runs")
    )
    # each length has few runs; they are searched in place
    mine = F.filter("runs", lambda r: (r["first"] <= F.col("number")) & (F.col("number") < r["first"] + r["n"]))[0]
    nth = F.expr("(number - run.first) div run.step")
    return (
        numbered.join(F.broadcast(by_length), "length")  # at most ``capacity`` rows
        .withColumn("run", mine)
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("run.sequence") + nth).alias("sequence_id"),
            (F.col("run.offset") + F.col("length") * F.expr("(number - run.first) % run.step")).alias("offset"),
        )
    )


def op5_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
