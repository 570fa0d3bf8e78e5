"""Near-duplicate classes: DartMinHash signatures, a banded join, exact verification.

A text is the weighted set of its word shingles, weighted by how often each occurs.
DartMinHash throws darts at the region below each element's weight: the darts of a
unit slab (and of slabs doubling in width above it) arrive along the rank axis as a
Poisson process seeded by the element and slab, so any two sets that share a region
share its darts. Darts that fall beside the weight are dropped; each dart names a
coordinate, and a coordinate keeps its earliest dart. Two signatures agree in a
coordinate with the probability of the sets' weighted Jaccard similarity, and the
work is about one dart for each element and each coordinate rather than their product.

Bands of coordinates become keys. Texts that share a key are compared without ever
forming all pairs of a bucket:

1. equal texts are one vertex from the start, named by their digest, not by an id;
2. each vertex is verified against the first hub of its buckets, which joins a large
   group of copies with one comparison each;
3. in buckets that still hold several components, every vertex is verified against
   the bucket's hub;
4. in those that do so even then, vertices outside the hub's component are compared
   with the bucket by signature, in tiles of bounded size; what may be similar is
   verified there, and only links between components leave a tile.

Verification is exact (weighted Jaccard of the shingle sets). A link at similarity
0.8 is missed only if no band agrees: (1 - 0.8**6)**40, about 5 in a million.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import components
from textloom.llm.pick import pick
from textloom.llm.textvec import SHINGLE, Words, mix, occurrences, one_of_each, release, shingles, slices, texts_of, unit
from textloom.session import cut, discard, table

BANDS, BAND = 40, 6
THRESHOLD = 0.8
#: Bytes of text signed at once; a text has about 1,800 darts however short it is.
SIGNED = 1 << 16
#: Vertices of a bucket that one side of a tile holds on average.
TILE = 256
_ARRIVAL, _HEIGHT, _NAME = (np.uint64(x) for x in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03))


def dart_signatures(
    elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_sets: int, k: int = BANDS * BAND
) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates for each weighted set; zeros for a set without weight.

    elements: 64-bit hashes, distinct in a set; weights: positive; owner: the set of each element.
    """
    total = np.bincount(owner, weights, n_sets) if len(owner) else np.zeros(n_sets)
    out = np.zeros((n_sets, k), np.uint64)
    # a slab for [0, 1), [1, 2), [2, 4), ... as far as the weight reaches
    slabs = 1 + np.ceil(np.log2(np.maximum(weights, 1.0))).astype(np.int64)
    of = np.repeat(np.arange(len(elements)), slabs)
    slab = np.arange(len(of)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    width = np.where(slab < 2, 1.0, np.exp2(slab - 1.0))
    floor = np.where(slab < 1, 0.0, width)
    seed = mix(elements[of] + mix(slab.astype(np.uint64)))
    weight, doc = weights[of], owner[of]
    limit = np.full(n_sets, k * math.log(k) + 2 * k) / np.maximum(total, 1e-300)
    todo = total > 0
    while todo.any():
        active = np.flatnonzero(todo[doc])
        rank, nth = np.zeros(len(active)), np.zeros(len(active), np.uint64)
        found: list[tuple] = []
        while len(active):
            left = (limit[doc[active]] - rank) * width[active]
            n = np.where(left < 1, 1, np.ceil(left + 3 * np.sqrt(np.maximum(left, 0)))).astype(np.int64)
            ends = np.cumsum(n)
            who = np.repeat(np.arange(len(active)), n)
            j = nth[who] + (np.arange(len(who)) - (ends - n)[who]).astype(np.uint64)
            s = seed[active][who]
            gap = -np.log(unit(mix(s + j * _ARRIVAL))) / width[active][who]
            run = np.cumsum(gap)
            at = rank[who] + run - np.concatenate(([0.0], run))[(ends - n)[who]]
            inside = at < limit[doc[active]][who]
            reached = inside[ends - 1]
            keep = np.flatnonzero(inside)
            s, j, w = s[keep], j[keep], active[who[keep]]
            hit = floor[w] + width[w] * unit(mix(s ^ (j * _HEIGHT + np.uint64(1)))) < weight[w]
            name = mix(s[hit] + mix(j[hit] * _NAME + np.uint64(2)))
            found.append((doc[w[hit]], at[keep[hit]], name))
            rank, nth, active = at[ends - 1][reached], (nth + n.astype(np.uint64))[reached], active[reached]
        d, r, name = (np.concatenate([x[i] for x in found]) for i in range(3))
        cell = d * k + ((name >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((r, cell))
        cell, name = cell[order], name[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        out.reshape(-1)[cell[first]] = name[first]
        filled = np.bincount(cell[first] // k, minlength=n_sets)
        out[todo & (filled < k)] = 0
        todo &= filled < k
        limit[todo] *= 2
    return out


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, how often, text number) of the distinct shingles of each text."""
    words = Words(texts)
    hashes, offsets = shingles(words.hashes, words.first, SHINGLE)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    return hashes[begin], np.diff(np.append(begin, len(hashes))).astype(float), owner[begin]


def dart_text_signatures(texts: list[str]) -> np.ndarray:
    elements, weights, owner = shingle_sets(texts)
    return dart_signatures(elements, weights, owner, len(texts))


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    part = signature.astype(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), part.shape[:2])
    for r in range(rows):
        key = mix(key * np.uint64(3) + part[:, :, r])
    return key


def multiset(text: str, weighted: bool = True) -> np.ndarray:
    """Sorted 32-bit hashes of a text's shingles; the n-th occurrence of one has a hash of its own."""
    words = Words([text])
    hashes, _ = shingles(words.hashes, words.first, SHINGLE)
    if weighted:
        hashes = mix(hashes + occurrences(hashes, np.zeros(len(hashes), np.int64)).astype(np.uint64))
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))


def _signed(signer: Callable[[list[str]], np.ndarray], bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordless = signer([""])[0]  # what the signer gives a set without shingles
        for whole in batches:
            batch = one_of_each(whole, 1, 0)
            for part in slices(batch, 2, SIGNED):
                sig = signer(texts_of(part.column(2)))
                keys = band_keys(sig, bands, rows).view(np.int64)
                bare = (sig == wordless).all(axis=1)
                small = (sig.astype(np.uint64) & np.uint64(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(1),
                        part.column(0),
                        pa.array([None if bare[i] else keys[i] for i in range(len(sig))], pa.list_(pa.int64())),
                        pa.array([x.tobytes() for x in small], pa.binary()),
                    ],
                    names=["v", "rep", "keys", "sketch"],
                )
        release()

    return run


def _sets(weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = [multiset(t, weighted).tobytes() for t in texts_of(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["v", "elements"])
        release()

    return run


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for part in slices(batch, 2):
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(both >= threshold * (len(p) + len(q) - both) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _tile(least: float, threshold: float):
    """Links between components of a tile: what may be similar by its signature is verified at once.

    A pair whose components are linked already is passed over, so a tile gives fewer
    links than it has rows, however many of its pairs are alike.
    """

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        one, other = tile[tile["side"] == 0], tile[tile["side"] == 1]
        if not len(one) or not len(other):
            return pd.DataFrame({"a": [], "b": []})
        p, q = (np.stack([np.frombuffer(x, np.uint8) for x in t["sketch"]]) for t in (one, other))
        pe, qe = ([np.frombuffer(x, np.uint32) for x in t["elements"]] for t in (one, other))
        pv, qv, pc, qc = (t[x].to_numpy(np.int64) for x in ("v", "c") for t in (one, other))
        number = {c: i for i, c in enumerate(sorted({*pc.tolist(), *qc.tolist()}))}
        label = np.arange(len(number))
        pn, qn = np.array([number[c] for c in pc.tolist()]), np.array([number[c] for c in qc.tolist()])
        p_size, q_size = np.array([len(x) for x in pe]), np.array([len(x) for x in qe])
        links = []
        for i in range(len(p)):
            alike = (p[i] == q).mean(axis=1) >= least
            # sets of too unlike sizes cannot reach the threshold
            alike &= np.minimum(q_size, p_size[i]) >= threshold * np.maximum(q_size, p_size[i]) - 1e-9
            for j in np.flatnonzero(alike):
                if label[pn[i]] == label[qn[j]]:
                    continue
                both = len(np.intersect1d(pe[i], qe[j], assume_unique=True))
                if both >= threshold * (len(pe[i]) + len(qe[j]) - both) - 1e-9:
                    links.append((pv[i], qv[j]))
                    label[label == label[qn[j]]] = label[pn[i]]
        return pd.DataFrame(links, columns=["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least this Jaccard similarity."""
    a = sets.select(F.col("v").alias("a"), F.col("elements").alias("of_a"))
    b = sets.select(F.col("v").alias("b"), F.col("elements").alias("of_b"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "of_a", "of_b")
    return both.mapInArrow(_similar(threshold), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    signer: Callable[[list[str]], np.ndarray] = dart_text_signatures,
    bands: int = BANDS,
    band: int = BAND,
    weighted: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, class_id) for every row: texts linked at ``threshold`` or equal share a class.

    A class is named by its least doc_id. Words are compared without case and
    punctuation. Null text: empty. Texts without a word: only like equal texts. Fewer
    than five words: one shingle of them all. Null doc_id: takes part like any other;
    a class of such rows alone has a null name. A repeated id with unlike texts: each
    row has the class of its own text. Repeated rows: each has a row. Empty table: no
    rows.
    """
    rows, names = _named(docs, threshold, signer, bands, band, weighted, id_col, text_col)
    return rows.select("doc_id", "v").join(names.select("v", "class_id"), "v").select("doc_id", "class_id")


def _vertex(text) -> Column:
    """The vertex of a text: 64 bits of its digest, so that rows need no ids to take part."""
    return F.xxhash64(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _vertex(F.col(text_col)).alias("v"), text.alias("text"))


def _named(docs, threshold, signer, bands, band, weighted, id_col, text_col) -> tuple[DataFrame, DataFrame]:
    """(rows, names): doc_id, v and text of every row; v, its component c and class_id of every vertex."""
    rows = _rows(docs, id_col, text_col)
    signed = rows.mapInArrow(_signed(signer, bands, band), "v bigint, rep bigint, keys array<bigint>, sketch binary")
    vertices = cut(signed.groupBy("v").agg(F.min("rep").alias("rep"), F.min("keys").alias("keys"), F.min("sketch").alias("sketch")))
    held = vertices.filter("keys IS NOT NULL").select("v", F.explode("keys").alias("key"))
    place = F.struct(F.xxhash64("v"), "v")
    buckets = cut(held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(place)["v"].alias("hub")).filter("n > 1"))
    members = cut(held.join(buckets, "key").select("key", "v", "n", "hub"))

    # one row of each text: that of its least id (rows that repeat it, or have none, are merged below)
    involved = cut(members.select("v").distinct().join(vertices.select("v", "rep"), "v").select(F.col("v").alias("of"), "rep"))
    own = pick(rows, involved).select("v", "text")
    sets = cut(
        own.mapInArrow(_sets(weighted), "v bigint, elements binary").groupBy("v").agg(F.max("elements").alias("elements"))
    )

    hub_place = F.struct(F.xxhash64("hub"), "hub")
    first = members.groupBy("v").agg(F.min(hub_place)["hub"].alias("hub")).filter("v <> hub")
    links = verified(first.select(F.col("v").alias("a"), F.col("hub").alias("b")), sets, threshold)
    labels = components(links)

    def labelled(labels: DataFrame) -> DataFrame:
        """Members with their component and their hub's, of the buckets that hold several."""
        own = labels.select("v", "c")
        hubs = labels.select(F.col("v").alias("hub"), F.col("c").alias("hub_c"))
        with_own = members.join(own, "v", "left").withColumn("c", F.coalesce("c", "v"))
        return with_own.join(hubs, "hub", "left").withColumn("hub_c", F.coalesce("hub_c", "hub"))

    def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels after further links between components."""
        a = labels.select(F.col("v").alias("a"), F.col("c").alias("ca"))
        b = labels.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        ends = links.join(a, "a", "left").join(b, "b", "left")
        ends = cut(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        if ends.isEmpty():
            discard(ends)
            return labels
        up = components(ends).select(F.col("v").alias("c"), F.col("c").alias("up"))
        known = labels.select("v", "c").unionByName(
            ends.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("c", F.col("v"))
        )
        new = cut(known.groupBy("v").agg(F.min("c").alias("c")).join(up, "c", "left").select("v", F.coalesce("up", "c").alias("c")))
        discard(ends, labels)
        return new

    rest = labelled(labels).filter("c <> hub_c").select(F.col("v").alias("a"), F.col("hub").alias("b")).distinct()
    rest = rest.join(first.select(F.col("v").alias("a"), F.col("hub").alias("b")), ["a", "b"], "left_anti")
    labels = contracted(labels, verified(rest, sets, threshold))

    still = labelled(labels).filter("n > 2")
    outside = F.col("c") != F.col("hub_c")
    sizes = still.groupBy("key").agg(F.count(F.when(outside, 1)).alias("n_out"), F.count(F.lit(1)).alias("n_all")).filter("n_out > 0")
    still = still.join(sizes, "key").join(vertices.select("v", "sketch"), "v").join(sets, "v")
    down, inner = F.ceil(F.col("n_out") / TILE), F.ceil((F.col("n_all") - F.col("n_out")) / TILE)
    still = cut(still.withColumns({"down": down.cast("int"), "inner": inner.cast("int"), "out": outside, "deal": F.xxhash64("v")}))
    block = F.when(F.col("out"), F.pmod("deal", "down")).otherwise(F.col("down") + F.pmod("deal", "inner")).cast("int")
    still = still.withColumn("block", block)
    one = still.filter("out").select("key", "v", "c", "sketch", "elements", F.lit(0).alias("side"), F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("down") + F.col("inner") - 1)).alias("j"))
    other = still.select("key", "v", "c", "sketch", "elements", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), F.col("block").alias("j"))
    # five standard deviations of the estimate under the threshold
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / (bands * band))
    last = one.unionByName(other).groupBy("key", "i", "j").applyInPandas(_tile(least, threshold), "a bigint, b bigint")
    labels = contracted(labels, last)

    named = vertices.select("v", "rep").join(labels, "v", "left").select("v", "rep", F.coalesce("c", "v").alias("c"))
    classes = named.groupBy("c").agg(F.min("rep").alias("class_id"))
    names = cut(named.select("v", "c").join(classes, "c").select("v", "c", "class_id"))
    discard(vertices, buckets, members, involved, sets, still, labels)
    return rows, names


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: of the least doc_id, one without an id if there is no other. Columns unchanged.

    A repeated id with unlike texts: each row stands for its own text. Repeated rows:
    one of a class's rows stays. Ties of the id: the least digest of the text. Texts
    are not shuffled while what is dropped is small enough for Spark to broadcast.
    """
    defaults = {"threshold": THRESHOLD, "signer": dart_text_signatures, "bands": BANDS, "band": BAND, "weighted": True}
    rows, names = _named(docs, **(defaults | options), id_col="doc_id", text_col="text")
    found = rows.select("doc_id", "v").groupBy("doc_id", "v").agg(F.count(F.lit(1)).alias("n"))
    classes = cut(found.join(names.select("v", "c"), "v"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "v"))
    keepers = classes.groupBy("c").agg(first.alias("first"))
    judged = classes.join(keepers, "c").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("v") == F.col("first.v")))
    judged = cut(judged.filter("NOT kept OR n > 1").select(F.col("doc_id").alias("of_id"), F.col("v").alias("of_v"), "kept"))
    discard(classes, names)
    # numbered names, so that columns of any names pass through
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = (F.col(f"c{docs.columns.index(x)}") for x in ("doc_id", "text"))
    marked = inner.withColumns({"own_id": doc_id.cast("bigint"), "own_v": _vertex(text)})
    same = F.col("own_id").eqNullSafe(F.col("of_id")) & (F.col("own_v") == F.col("of_v"))
    kept = marked.join(judged.filter("NOT kept").select("of_id", "of_v"), same, "left_anti")
    again = judged.filter("kept").select("of_id", "of_v")
    if not again.isEmpty():
        twice = kept.join(again, same, "left_semi").dropDuplicates(["own_id", "own_v"])
        kept = kept.join(again, same, "left_anti").unionByName(twice)
    return kept.drop("own_id", "own_v").toDF(*docs.columns)


def op2_dart_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
