"""Clustering against the same rounds with whole distances in plain Python integers."""

import hashlib
import random

import numpy as np
import pytest

from beaconframe.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int"


def _plain(rows, k, rounds, seed, scale, dims):
    kept = []
    for i, x in rows:
        x = None if x is None else [None if c is None else float(np.float32(c)) for c in x]
        if x is not None and len(x) == dims and all(c is not None and np.isfinite(c) for c in x):
            kept.append((i, [int(np.floor(c * scale)) for c in x]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(x) for _, x in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centers)) for _, x in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centers)):
            own = [x for (_, x), (_, c) in zip(kept, at, strict=True) if c == j]
            if own:
                centers[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = assign()
    total = {}
    for d, j in at:
        total[j] = total.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, d, total[j], sum(total.values()), sha[j]) for (i, _), (d, j) in zip(kept, at, strict=True)), key=str)


def _got(df, **how):
    return sorted((tuple(r) for r in centroids.centroid_clusters(df, **how).collect()), key=str)


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 7), (5, 40)])
def test_equals_plain_rounds_with_ties_repeats_and_odd_rows(spark, seed, k):
    r = random.Random(seed)
    rows = [(i, [r.choice([-1.0, -0.5, 0.0, 0.251, 1.75]) for _ in range(4)]) for i in range(120)]
    rows += [rows[3]] * 30 + [(7, [0.1] * 4), (None, [0.5, 0.5, -0.5, 0.0]), (500, None), (501, []), (502, [1.0] * 3), (503, [1.0, None, 1.0, 1.0]), (504, [float("nan")] * 4), (505, [float("inf")] * 4)]
    df = spark.createDataFrame([(i, x, "c", 1) for i, x in rows], SCHEMA)
    assert _got(df, k=k, rounds=4, seed=seed, scale=16, dims=4) == _plain(rows, k, 4, seed, 16, 4)


def test_changes_alone_give_the_same_products():
    g = np.random.default_rng(3)
    x, a = g.integers(-300, 300, (200, 64)), g.integers(-300, 300, (9, 64))
    b = a.copy()
    b[2, 5] += 4
    b[7] = g.integers(-300, 300, 64)
    assert (centroids.add_changes(x @ a.T, x, b - a) == x @ b.T).all()
    big = g.integers(-(1 << 26), 1 << 26, (50, 64))
    assert (centroids._product(big, big) == big @ big.T).all()


def test_fewer_vectors_than_centroids_and_an_empty_table(spark):
    assert centroids.centroid_clusters(spark.createDataFrame([], SCHEMA)).collect() == []
    got = _got(spark.createDataFrame([(5, [1.0, 2.0], "", 0), (6, [1.0, 2.0], "", 0)], SCHEMA), dims=2)
    assert [x[:5] for x in got] == [(5, got[0][1], 0, 0, 0), (6, got[0][1], 0, 0, 0)]


def test_numbers_that_do_not_fit_are_an_error(spark):
    with pytest.raises(OverflowError):
        centroids.centroid_clusters(spark.createDataFrame([(1, [1e30, 0.0], "", 0)], SCHEMA), dims=2)
