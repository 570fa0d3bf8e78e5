"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks; every pair of a query block and a
candidate block is a tile. Inside a tile, vectors are quantised to int8 and one
integer matrix product gives every inner product up to an error that follows from
the quantisation residues. A pair survives if its upper bound reaches the k-th
largest lower bound of its query; survivors are computed again in double precision
and the best k of the tile are kept. Tiles of a query are merged by heaps.

The result is exact: nothing that could be among the k nearest is dropped. A tile
holds a bounded number of vectors however many copies of a vector there are, as
blocks are dealt by a hash of id and vector. Vectors travel to one row (or column)
of tiles, so the shuffle grows with rows times blocks, not with pairs.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import cut, table

K = 20
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 4096
#: Candidate blocks at least, so that small tables are spread as well.
LEAST_BLOCKS = 32
#: Pairs computed again at a time.
PAIRS = 1 << 16


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes as float32, scale, norm of the residue, norm of what the codes stand for)."""
    scale = np.abs(v).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(v / scale[:, None])
    stands = codes * scale[:, None]
    return codes.astype(np.float32), scale, np.linalg.norm(v - stands, axis=1), np.linalg.norm(stands, axis=1)


def nearest(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query ids, candidate ids, scores) of each query's k largest inner products among other ids."""
    qc, qs, qe, qn = quantise(q)
    cc, cs, ce, cn = quantise(c)
    # int8 products summed in float32: whole numbers below 2**24 for up to 1,000 dimensions, else in double
    product = qc @ cc.T if q.shape[1] <= 1000 else qc.astype(np.float64) @ cc.T.astype(np.float64)
    about = product.astype(np.float64) * qs[:, None] * cs[None, :]
    error = qe[:, None] * (cn + ce)[None, :] + qn[:, None] * ce[None, :]
    error += 1e-9 * (qn + qe)[:, None] * (cn + ce)[None, :]
    own = q_ids[:, None] == c_ids[None, :]
    low = np.where(own, -np.inf, about - error)
    keep = min(k, low.shape[1])
    bar = np.partition(low, low.shape[1] - keep, axis=1)[:, low.shape[1] - keep]
    rows, cols = np.nonzero((about + error >= bar[:, None]) & ~own)
    scores = np.empty(len(rows))
    for a in range(0, len(rows), PAIRS):
        part = slice(a, a + PAIRS)
        # each row is summed by itself, from the first component to the last, so equal vectors have equal scores
        scores[part] = np.cumsum(q[rows[part]] * c[cols[part]], axis=1)[:, -1]
    order = np.lexsort((c_ids[cols], -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    begin = np.searchsorted(rows, np.arange(len(q_ids)))
    first = np.arange(len(rows)) - begin[rows] < k
    return q_ids[rows[first]], c_ids[cols[first]], scores[first]


def _tile(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": [], "ids": [], "scores": []})
        q = np.stack(list(queries["query_embedding"])).astype(np.float64)
        c = np.stack(list(candidates["candidate_embedding"])).astype(np.float64)
        q_ids, c_ids = queries["query_vec_id"].to_numpy(np.int64), candidates["candidate_vec_id"].to_numpy(np.int64)
        found_q, found_c, scores = nearest(q_ids, q, c_ids, c, k)
        ends = np.flatnonzero(np.diff(found_q)) + 1
        begin = np.concatenate(([0], ends)) if len(found_q) else np.zeros(0, np.int64)
        stop = np.append(ends, len(found_q)) if len(found_q) else begin
        return pd.DataFrame(
            {
                "query_id": found_q[begin],
                "ids": [found_c[a:z] for a, z in zip(begin, stop, strict=True)],
                "scores": [scores[a:z] for a, z in zip(begin, stop, strict=True)],
            }
        )

    return run


def _merge(k: int):
    def run(key: tuple, tiles: pd.DataFrame) -> pd.DataFrame:
        runs = [list(zip((-s for s in t.scores), t.ids, strict=True)) for t in tiles.itertuples()]
        best = []
        for score, vec_id in heapq.merge(*runs):
            best.append((key[0], len(best) + 1, int(vec_id), -float(score)))
            if len(best) == k:
                break
        return pd.DataFrame(best, columns=["query_id", "rank", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, embedding (double), dim of the vectors that take part, one row for each id."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = rows.filter(F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))


def search(
    vectors: DataFrame,
    is_query,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Each query's k nearest other vectors by inner product: query_id, rank, vec_id, score.

    Queries are the vectors whose vec_id meets ``is_query``. Null, zero, empty or
    non-finite vectors and null ids take no part. Vectors of unlike lengths are not
    compared. Ties: the smaller vec_id first. A repeated id counts as one vector (the
    smallest of its rows). Fewer than k candidates: all of them. Empty table: no rows.
    """
    rows = cut(usable(vectors, id_col, vector_col))
    query = is_query(F.col("vec_id"))
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count(F.when(query, 1))).first()
    across = max(-(-n // CANDIDATE_BLOCK), min(LEAST_BLOCKS, -(-n // 64)), 1)
    down = max(-(-n_queries // QUERY_BLOCK), 1)
    deal = F.xxhash64("vec_id", "embedding")
    queries = rows.filter(query).withColumn("q", F.pmod(deal, F.lit(down)).cast("int"))
    queries = queries.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    candidates = rows.withColumn("c", F.pmod(deal, F.lit(across)).cast("int"))
    candidates = candidates.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    # cogroup tells its sides' columns apart only if they are columns of their own
    queries = queries.select(*[F.col(x).alias(f"query_{x}") for x in queries.columns])
    candidates = candidates.select(*[F.col(x).alias(f"candidate_{x}") for x in candidates.columns])
    tiles = (
        queries.groupBy("query_dim", "query_q", "query_c")
        .cogroup(candidates.groupBy("candidate_dim", "candidate_q", "candidate_c"))
        .applyInPandas(_tile(k), "query_id bigint, ids array<bigint>, scores array<double>")
    )
    return tiles.groupBy("query_id").applyInPandas(_merge(k), "query_id bigint, rank int, vec_id bigint, score double")


def op1_block_matrix_search(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


OP1_SQL = f"""
WITH rows AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
), usable AS (
  SELECT vec_id, e FROM rows
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
