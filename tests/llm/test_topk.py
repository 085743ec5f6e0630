import math
import random

import pytest

from beaconframe.llm import topk


def brute(rows, k, every):
    ok = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in ok:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(ok[q], ok[x], strict=True)), x) for x in ok if x != q and len(ok[x]) == len(ok[q]))
            out |= {(q, r + 1, x, -n) for r, (n, x) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("dim", [1, 3, 64])
def test_equals_brute_force(spark, dim, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    r = random.Random(dim)
    common = [r.gauss(0, 1) for _ in range(dim)]
    rows = [(i, common if i % 3 == 0 else [r.gauss(0, 1) for _ in range(dim)]) for i in range(200)]
    rows += [(500, None), (510, [None] * dim), (520, [math.nan] * dim), (530, [math.inf] * dim), (None, common), (540, [1e5] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score")
    got = {(x.query_id, x.rank, x.vec_id, x.score) for x in topk.exact_top_k(df, 10, 10).collect()}
    assert got == brute(rows, 10, 10)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.exact_top_k(df, 10, 10).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.exact_top_k(df.limit(0)).collect() == []
    assert topk.exact_top_k(df.where("vec_id = 0")).collect() == []
