"""Runs against the definition, tried at every place and period in plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconframe.llm import periodic_runs as R


def _plain_runs(w, least=12):
    """Every maximal stretch with a period q and two of it at least; of a stretch the smallest period only."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            if length >= max(least, 2 * q):
                found.setdefault((s, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def _plain(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = _plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_random_periodic_words(seed):
    r = random.Random(seed)
    docs = []
    for _ in range(r.randint(1, 6)):
        w = []
        while len(w) < r.randint(0, 150):
            unit = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randint(1, 9))]
            w += (unit * r.randint(1, 9))[: r.randint(1, 60)]
        docs.append(w)
    least = r.choice([12, 12, 4, 2])
    counts = np.array([len(w) for w in docs])
    doc, start, length, period = R.find_runs(np.array(sum(docs, []), np.int64), counts, least)
    got = [[] for _ in docs]
    for d, s, n, q in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        got[d].append((s, n, q))
    assert got == [_plain_runs(w, least) for w in docs]


def test_digests_of_odd_rows_and_planted_periods(spark):
    r = random.Random(4)
    words = ["la", "Le", "x y", " ", "東京", "a,", "b"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 200)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " \t\n\x0b"), (None, "a b " * 20), (203, "no run here at all"), (3, docs[3][1]), (204, "go " * 1_500), (205, " lead\x1cing  and\ttrailing "), (206, ("one two three four five six seven " * 9 + "stop ") * 12)]
    df = spark.createDataFrame([(i, t, 7, "z") for i, t in docs], "doc_id long, text string, seed int, runs string")
    h = F.crc32(F.col("doc_id").cast("string"))
    got = sorted((tuple(x) for x in R.run_digests(R.periodic_runs(df, seed=h)).collect()), key=str)
    assert got == sorted((_plain(*d) for d in docs), key=str)
    bare = sorted((tuple(x) for x in R.run_digests(R.periodic_runs(df)).collect()), key=str)
    assert bare == sorted((_plain(*d, plant=False) for d in docs), key=str)


def test_empty_table(spark):
    assert R.run_digests(R.periodic_runs(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_a_long_text_of_many_nested_periods():
    unit = [1] * 20 + [2]
    w = (unit * 30 + [3]) * 40
    w = np.array(w[: 20_000], np.int64)
    doc, start, length, period = R.find_runs(w, np.array([len(w)]))
    got = set(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    assert (0, len(w), 631) in got and (0, 630, 21) in got and (0, 20, 1) in got
    for s, n, q in list(got)[::7]:
        assert (w[s : s + n - q] == w[s + q : s + n]).all() and (s == 0 or w[s - 1] != w[s - 1 + q]) and (s + n == len(w) or w[s + n] != w[s + n - q])
