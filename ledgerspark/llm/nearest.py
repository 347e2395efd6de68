"""Nearest neighbours by cosine: block matrix join over int8 product tiles.

Queries and candidates are hashed into groups; each grid cell (query group,
candidate group) is one task's work. In a cell, unit vectors are quantised to
int8 with a scale of their own, products of int8 tiles give every cosine to
within a known error, and only pairs whose upper bound reaches the k-th lower
bound are recomputed in double precision. The result is exact: bounds prune,
they never decide. Cells' k best are merged per query.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without id; vectors of unequal length are
never compared; equal scores go to the smaller id; a repeated id counts once,
with its best score; a query meets every row but those of its own id; with fewer
than k candidates all are returned; an empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import partitions

#: Bytes of the vectors (as doubles) of a query group and of a candidate group, at most; rows of the latter, at least.
QUERY_BYTES, CANDIDATE_BYTES, LEAST_ROWS = 16 << 20, 32 << 20, 1024
QUERY_ROWS = 4096
#: Products of a tile; a cell holds a few tables of so many numbers at once.
TILE_PAIRS = 1 << 20
#: Bytes of vectors that are recomputed together.
PAIR_BYTES = 8 << 20


def valid(vector: str):
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def cosines(a, b):
    """Row-wise cosines of two equal-shaped double matrices, summed in component order."""
    import numpy as np

    dot, left, right = (np.zeros(len(a)) for _ in range(3))
    for i in range(a.shape[1]):
        x, y = a[:, i], b[:, i]
        dot += x * y
        left += x * x
        right += y * y
    return np.clip(dot / np.sqrt(left * right), -1.0, 1.0)


def quantised(x):
    """int8 codes, scales and errors (Euclidean distance of unit vector and code)."""
    import numpy as np

    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    off = unit - codes * scale[:, None]
    return codes, scale, np.sqrt((off * off).sum(axis=1))


def cell_best(qid, q, cid, c, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k best of the candidates, as sorted (-score, id)."""
    import numpy as np

    best: list[list[tuple[float, int]]] = [[] for _ in qid]
    q8, qs, qe = quantised(q)
    # Sums of int8 products are exact in float32 below 2^24.
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    qk = q8.astype(kind)
    tile, pairs = max(k, TILE_PAIRS // len(qid)), max(1, PAIR_BYTES // (8 * q.shape[1]))
    for a in range(0, len(cid), tile):
        part, ids = c[a : a + tile], cid[a : a + tile]
        c8, cs, ce = quantised(part)
        near = (qk @ c8.astype(kind).T) * qs[:, None] * cs[None, :]
        bound = qe[:, None] + (1 + qe[:, None]) * ce[None, :] + 1e-6
        own = qid[:, None] == ids[None, :]
        low = np.where(own, -np.inf, near - bound)
        high = np.where(own, -np.inf, near + bound)
        # A repeated id may hold several of the k highest lower bounds.
        first = np.zeros(len(ids), bool)
        first[np.unique(ids, return_index=True)[1]] = True
        if not first.all():
            low[:, ~first] = -np.inf
        floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(qid), -np.inf)
        floor = np.maximum(floor, [-b[-1][0] if len(b) == k else -np.inf for b in best])
        rows, cols = np.nonzero((high >= floor[:, None]) & ~own)
        if not len(rows):
            continue
        score = np.concatenate([cosines(q[rows[i : i + pairs]], part[cols[i : i + pairs]]) for i in range(0, len(rows), pairs)])
        order = np.lexsort((ids[cols], -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        for s, e in zip(starts, np.r_[starts[1:], len(rows)], strict=True):
            kept, seen = [], set()
            mine = zip((-score[s:e]).tolist(), ids[cols[s:e]].tolist(), strict=True)
            for x in heapq.merge(best[rows[s]], mine):
                if x[1] not in seen:
                    seen.add(x[1])
                    kept.append(x)
                    if len(kept) == k:
                        break
            best[rows[s]] = kept
    return best


def nearest(vectors: DataFrame, is_query, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest of each query row.

    ``is_query`` is a boolean column over ``vectors``."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id).isNotNull() & valid(vector)).select(
        F.col(id).cast("long").alias("id"), F.col(vector).alias("v"), F.size(vector).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    n, nq, dim = rows.agg(F.count("*"), F.count_if("q"), F.coalesce(F.max("dim"), F.lit(1))).first()
    most = max(1, CANDIDATE_BYTES // (8 * dim))
    groups = max(1, -(-n // min(most, max(LEAST_ROWS, n // (4 * partitions(spark))))))
    query_groups = max(1, -(-nq // max(1, min(QUERY_ROWS, QUERY_BYTES // (8 * dim)))))
    side = F.pmod(F.xxhash64("id"), F.lit(query_groups)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = rows.where("q").select("dim", side.alias("i"), every(groups).alias("j"), "id", "v")
    candidates = rows.select("dim", every(query_groups).alias("i"), block.alias("j"), "id", "v")

    def cell(left, right):
        import numpy as np
        import pyarrow as pa

        def matrix(t):
            ids, v = t.column("id").combine_chunks(), t.column("v").combine_chunks()
            ids = ids.to_numpy(zero_copy_only=False)
            return ids, v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)

        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            (qid, q), (cid, c) = matrix(left), matrix(right)
            for i, found in zip(qid.tolist(), cell_best(qid, q, cid, c, k), strict=True):
                out += [(i, j, -s) for s, j in found]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    keys = ("dim", "i", "j")
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
