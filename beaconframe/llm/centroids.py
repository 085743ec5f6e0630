"""Exact centroid clustering that keeps every vector's dot products with all centroids.

The squared distance of a vector x to a centroid c is x.x - 2 x.c + c.c, so a
vector that carries its dot products needs nothing else to find its nearest
centroid. They are computed once, in the pass that scales the vectors. After a
round only the components in which a centroid has changed are multiplied with
the vector and added; a centroid that stays costs nothing. All numbers are
integers, so no round adds any error.

Vectors, dot products and clusters are one table in the shared folder for each
round: a map over the last one, with nothing shuffled but the partial sums of
k clusters. k centroids are all that goes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconframe.operators.state import Scratch, materialize

#: Vectors that a task works on at a time.
ROWS = 4096
_STATE = "vec_id long, v array<long>, dots array<long>, cluster int, distance long"


def usable_vectors(df: DataFrame, dims: int, scale: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): floor(scale * component) of the vectors of exactly `dims` components, none null or non-finite."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(v.isNotNull() & (F.size(v) == dims) & fine)
    # floor() of a double is a long in Spark: what does not fit is told apart before that.
    return some.select("vec_id", F.transform("v", lambda x: x * F.lit(float(scale))).alias("v"))


def _product(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T of integers, by doubles where they hold every partial sum exactly."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, x.shape[1]) < 2.0**53:
        return (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return x @ c.T


def add_changes(dots: np.ndarray, x: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Dot products after the centroids moved by `change`: only its nonzero components are multiplied."""
    out = dots.copy()
    for j in np.flatnonzero(change.any(1)):
        parts = np.flatnonzero(change[j])
        out[:, j] += _product(x[:, parts], change[j : j + 1, parts])[:, 0]
    return out


def nearest(dots: np.ndarray, x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, ties to the smaller one; squared distance)."""
    part = (centroids * centroids).sum(1)[None, :] - 2 * dots
    cluster = part.argmin(1)
    return cluster.astype(np.int32), part[np.arange(len(x)), cluster] + (x * x).sum(1)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, n)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))


def _advance(centroids: np.ndarray, change: np.ndarray | None):
    """A mapInArrow function that brings the dot products up to date (from nothing where `change` is None) and assigns the vectors."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            x = _matrix(batch.column("v"), dims)
            dots = _product(x, centroids) if change is None else add_changes(_matrix(batch.column("dots"), k), x, change)
            cluster, distance = nearest(dots, x, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _lists(x), _lists(dots), pa.array(cluster), pa.array(distance)], ["vec_id", "v", "dots", "cluster", "distance"])

    return run


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The `k` vectors (all, if fewer) with the smallest hexadecimal SHA-256 of `seed:vec_id`; rows without an id come last, equal ids go by their components."""
    at = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(at.asc_nulls_last(), "v").select("v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def centroid_clusters(df: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, dims: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each usable vector.

    Components become floor(scale * x). Each round assigns every vector to the
    nearest centroid and moves every centroid with vectors to the floor of
    their mean, component by component; empty ones stay. After the last round
    all are assigned once more. Null vectors, vectors of another length and
    vectors with a null or non-finite component take no part. A vector without
    an id takes part and starts a centroid only where too few others do;
    repeated rows count each and are returned each; other columns are ignored,
    whatever their names; fewer than `k` vectors give as many centroids; an
    empty table gives an empty result. An error is raised where a squared
    distance or a sum may not fit in 64 bits.
    """
    spark = df.sparkSession
    real = usable_vectors(df, dims, scale, vec_id, embedding)
    n, largest = real.agg(F.count("*"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    if n == 0:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    most = float(largest) + 1
    if 4 * dims * most**2 >= 2.0**63 or n * most >= 2.0**63:
        raise OverflowError(f"components up to {largest:g} may give distances or sums beyond 64 bits")
    vectors = real.select("vec_id", F.transform("v", lambda x: F.floor(x)).cast("array<long>").alias("v"))
    with Scratch(spark) as table:
        centroids, change, state = first_centroids(vectors, k, seed), None, vectors
        for turn in range(rounds + 1):
            before, state = state, table(state.mapInArrow(_advance(centroids, change), _STATE), "assigned")
            if turn:
                table.drop(before)
            if turn == rounds:
                break
            moved = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dims))).collect()
            after = centroids.copy()
            for row in moved:
                after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
            centroids, change = after, after - centroids
        inertia = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
        total = sum(inertia.values())
        if total >= 1 << 63:
            raise OverflowError("the distances' sum is beyond 64 bits")
        # One row for each of k centroids.
        told = F.broadcast(spark.createDataFrame([(j, s, total, _digest(centroids[j])) for j, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
        return materialize(state.select("vec_id", "cluster", "distance").join(told, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters")
