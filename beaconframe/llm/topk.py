"""Exact top-k inner products with multi-resolution segment statistics.

For two vectors cut into the same segments, the squared distance is at least
the sum over segments of length * ((mean - mean)^2 + (deviation - deviation)^2),
so their inner product is at most the sum of length * (mean * mean + deviation
* deviation). Coarse segments give a cheap bound, finer ones a closer bound;
only pairs whose bound reaches the running k-th best score are computed.

Queries and candidates are dealt into blocks of bounded size. Each pair of
blocks is one group, so no task or driver ever holds all of either side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of queries and of a block of candidates.
QUERY_BLOCK, ROW_BLOCK = 2048, 8192
#: Lengths of the finest to the coarsest segments, as divisors of 1 << level.
LEVELS = (4, 16, 32)
#: Scores are exact as long as no component exceeds this after scaling.
MOST = float(1 << 62)


def segment_stats(x: np.ndarray, n: int) -> np.ndarray:
    """Means and deviations of n segments, each times the root of the segment's length, side by side."""
    cuts = np.linspace(0, x.shape[1], n + 1).astype(int)
    cuts = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    root = np.array([math.sqrt(b - a) for a, b in cuts])
    mean = np.stack([x[:, a:b].mean(1) for a, b in cuts], 1) * root
    dev = np.stack([x[:, a:b].std(1) for a, b in cuts], 1) * root
    return np.concatenate([mean, dev], 1)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row inner products of integers."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) < 2**53:
        return np.einsum("ij,ij->i", q.astype(np.float64), x.astype(np.float64)).astype(np.int64)
    return np.einsum("ij,ij->i", q, x)


def block_top_k(q_id: np.ndarray, q: np.ndarray, x_id: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's id, ids, scores) of the k best rows of a block for each query, other than rows with its own id."""
    order = np.argsort(x_id, kind="stable")
    x_id, x = x_id[order], x[order]
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    stats = [(segment_stats(qf, n), segment_stats(xf, n)) for n in LEVELS if n <= q.shape[1]] or [(np.abs(qf), np.abs(xf))]
    norm = np.sqrt((xf**2).sum(1))
    for i in range(len(q)):
        slack = 1e-9 * (1 + norm * math.sqrt(float((qf[i] ** 2).sum())))
        bound = stats[0][1] @ stats[0][0][i] + slack
        bound[x_id == q_id[i]] = -np.inf
        some = np.argpartition(-bound, min(k, len(bound)) - 1)[:k]
        some = some[bound[some] > -np.inf]
        if not len(some):
            continue
        scores = _exact(np.broadcast_to(q[i], (len(some), q.shape[1])), x[some])
        least = scores.min() if len(scores) >= k else -np.inf
        rows = np.flatnonzero((bound >= least) & (bound > -np.inf))
        for of_q, of_x in stats[1:]:
            rows = rows[of_x[rows] @ of_q[i] + slack[rows] >= least]
        scores = _exact(np.broadcast_to(q[i], (len(rows), q.shape[1])), x[rows])
        best = np.lexsort((x_id[rows], -scores))[:k]
        yield int(q_id[i]), x_id[rows[best]], scores[best]


def _pair(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            q, x = np.stack(queries["v"].to_numpy()).astype(np.int64), np.stack(rows["v"].to_numpy()).astype(np.int64)
            for one, ids, scores in block_top_k(queries["vec_id"].to_numpy(np.int64), q, rows["vec_id"].to_numpy(np.int64), x, k):
                out.append(pd.DataFrame({"query_id": one, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})

    return run


def scaled(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * component), for the vectors without null or non-finite components."""
    v = F.col(embedding).cast("array<double>")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= MOST / scale))
    return df.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).cast("array<long>").alias("v")).where("vec_id is not null")


def exact_top_k(df: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows with the highest integer inner product for each query.

    Queries are the rows whose id is divisible by `every`; candidates are all
    other rows of the same length. Ties go to the smaller vec_id. Null vectors,
    vectors with a null or non-finite component (or one beyond the range of a
    long) and rows without an id take no part. Of rows that repeat an id and
    vector one counts; rows with a query's own id are its own. Fewer than k
    candidates give fewer rows; an empty table gives an empty result. Scores
    are 64-bit integers: an error is raised if the largest component squared,
    times the length of the vectors, could exceed them.
    """
    rows = scaled(df, vec_id, embedding, scale).distinct().withColumn("d", F.size("v"))
    is_query = F.col("vec_id") % every == 0
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x).cast("double"))))
    n, n_queries, largest, longest = rows.agg(F.count("*"), F.count_if(is_query), largest, F.max("d")).first()
    if n and longest and largest**2 * longest >= 2.0**63:
        raise OverflowError(f"components up to {largest:g} may give scores beyond 64 bits")
    blocks, query_blocks = max(1, math.ceil(n / ROW_BLOCK)), max(1, math.ceil(n_queries / QUERY_BLOCK))
    deal = lambda parts, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(parts)).cast("int")
    queries = rows.where(is_query).withColumn("a", deal(query_blocks, 1)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    against = rows.withColumn("b", deal(blocks, 2)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    found = queries.groupBy("a", "b", "d").cogroup(against.groupBy("a", "b", "d")).applyInPandas(_pair(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
