"""Exact top-k search by columnar branch and bound.

Queries and candidates are dealt into blocks of bounded size and every pair of
blocks is one cell, hence one bounded task. In a cell the candidates lie in
vertical layout (a row per dimension). Inner products accumulate one block of
dimensions at a time; by Cauchy-Schwarz the dimensions that remain can add at
most the product of the two remaining norms, so candidates that cannot reach
the k-th best score any more are dropped and the survivors compacted before
the next block of dimensions is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._util import finite_vector, matrix, row_count_and

#: Most candidates and queries of a cell.
CANDIDATES, QUERIES = 32_768, 16_384
#: Candidates per vertical block, queries that share a scan, dimensions per step.
SPAN, TILE, STEP = 4096, 16, 8
LEAST_LONG, GREATEST_LONG = -(1 << 63), (1 << 63) - 1


def best_of_cell(q_ids, q, c_ids, c, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and scores of each query's k best in the cell.

    q and c hold integers. A candidate with the query's id is passed over.
    Ties go to the smaller id.
    """
    exact = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2**52
    if not exact:
        return _best_plain(q_ids, q, c_ids, c, k)
    order = np.lexsort((c_ids, -np.einsum("ij,ij->i", c.astype(np.float64), c)))
    c_ids, vertical = c_ids[order], np.ascontiguousarray(c[order].T, dtype=np.float64)
    q = q.astype(np.float64)
    dims = q.shape[1]
    edges = list(range(0, dims, STEP)) + [dims]
    # Norms of what remains from each edge on.
    rest = lambda m: [np.sqrt(np.square(m[e:]).sum(axis=0)) for e in edges[1:]]
    out_q, out_c, out_s = [], [], []
    spans = [(s, min(s + SPAN, len(c_ids))) for s in range(0, len(c_ids), SPAN)]
    c_rest = [rest(vertical[:, a:b]) for a, b in spans]
    for t in range(0, len(q), TILE):
        tile, ids = q[t : t + TILE], q_ids[t : t + TILE]
        q_rest = rest(tile.T)
        best_s = np.full((len(tile), 0), 0.0)
        best_i = np.zeros((len(tile), 0), dtype=np.int64)
        threshold = np.full(len(tile), -np.inf)
        for (a, b), remaining in zip(spans, c_rest, strict=True):
            alive = np.arange(b - a)
            partial = np.zeros((len(tile), b - a))
            for j in range(len(edges) - 1):
                block = vertical[edges[j] : edges[j + 1], a:b]
                partial = partial + tile[:, edges[j] : edges[j + 1]] @ (block if len(alive) == b - a else block[:, alive])
                bound = partial + q_rest[j][:, None] * remaining[j][alive][None, :]
                keep = (bound * (1 + 1e-12 * np.sign(bound)) + 0.25 >= threshold[:, None]).any(axis=0)
                if not keep.all():
                    alive, partial = alive[keep], partial[:, keep]
                if not len(alive):
                    break
            if not len(alive):
                continue
            found = c_ids[a:b][alive]
            scores = np.where(found[None, :] == ids[:, None], -np.inf, partial)
            all_s = np.concatenate([best_s, scores], axis=1)
            all_i = np.concatenate([best_i, np.broadcast_to(found, scores.shape)], axis=1)
            if all_s.shape[1] > k:
                take = np.stack([_first(s, i, k) for s, i in zip(all_s, all_i, strict=True)])
                best_s, best_i = np.take_along_axis(all_s, take, 1), np.take_along_axis(all_i, take, 1)
                threshold = best_s[:, -1]
            else:
                best_s, best_i = all_s, all_i
        good = best_s > -np.inf
        out_q.append(np.broadcast_to(ids[:, None], best_s.shape)[good])
        out_c.append(best_i[good])
        out_s.append(np.rint(best_s[good]).astype(np.int64))
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, best first."""
    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
    near = np.flatnonzero(scores >= kth)
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _best_plain(q_ids, q, c_ids, c, k):
    """For components so large that sums leave the exact range of doubles."""
    out = []
    big = c.astype(object)
    for own, row in zip(q_ids, q.astype(object), strict=True):
        scores = [min(max(s, LEAST_LONG), GREATEST_LONG) for s in big @ row]
        ranked = sorted((-s, i) for s, i in zip(scores, c_ids.tolist(), strict=True) if i != own)[:k]
        out += [(own, i, -s) for s, i in ranked]
    columns = list(zip(*out, strict=True)) or [[], [], []]
    return tuple(np.array(x, dtype=np.int64) for x in columns)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k highest integer inner products among all other rows.

    A component x counts as floor(scale * x). Returns query_id, rank (from 1),
    vec_id, score; ties go to the smaller vec_id; a query with fewer than k
    other rows gets them all.

    Rows take no part if their id is null, or their vector is null or holds
    null or non-finite components. Rows that repeat an id count once, with the
    least of their vectors. Vectors are compared with those of their own
    dimension only. Scores beyond 64 bits saturate. An empty table, or one
    without queries, gives no rows. Further columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q"))
        .where(F.col("vec_id").isNotNull() & finite_vector(F.col("_v")))
        .groupBy("vec_id")
        .agg(F.min("_v").alias("_v"), F.max("_q").alias("_q"))
        .select("vec_id", "_q", F.transform("_v", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("_v"))
        .withColumn("_dim", F.size("_v"))
    )
    n = row_count_and(rows, F.count_if("_q").alias("queries"))
    lanes = max(spark.sparkContext.defaultParallelism, 1)
    groups = max(1, -(-n["rows"] // min(CANDIDATES, max(2048, n["rows"] // (2 * lanes)))))
    blocks = max(1, -(-n["queries"] // QUERIES))
    spread = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    candidates = rows.select("_dim", spread(groups).alias("_g"), every(blocks).alias("_b"), F.lit(False).alias("_ask"), "vec_id", "_v")
    queries = rows.where("_q").select("_dim", every(groups).alias("_g"), spread(blocks).alias("_b"), F.lit(True).alias("_ask"), "vec_id", "_v")

    def cell(table: pa.Table) -> pa.Table:
        ask = table.column("_ask").to_numpy()
        ids, m = table.column("vec_id").to_numpy(), matrix(table.column("_v"), np.int64)
        found = best_of_cell(ids[ask], m[ask], ids[~ask], m[~ask], k) if ask.any() and not ask.all() else ([], [], [])
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    best = candidates.unionByName(queries).groupBy("_dim", "_g", "_b").applyInArrow(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
