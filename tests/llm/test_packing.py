"""Packing against best fit of the pieces one by one, over the whole table."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from beaconframe.llm import packing
from beaconframe.llm.queries import tokenizer_path


def _one_by_one(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(size - n)
    return Counter(rooms)


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_best_fit_one_by_one(seed):
    r = random.Random(seed)
    size = r.choice([7, 16, 50, 64])
    lengths = [r.randint(1, r.choice([size, size // 2, 3])) for _ in range(r.randint(0, 250))]
    rows, seen = defaultdict(int), Counter()
    for length, first, n, row, per in packing.best_fit_runs(Counter(lengths), size):
        assert first == seen[length]
        seen[length] += n
        for i in range(n):
            rows[row + i // per] += length
    assert seen == Counter(lengths) and Counter(size - x for x in rows.values()) == _one_by_one(lengths, size)


def _rows(packed):
    return sorted((r["row"], tuple(r["doc_ids"]), tuple(r["parts"]), tuple(r["cu_seqlens"]), bytes(r["input_ids"]), bytes(r["position_ids"]), r["n_tokens"]) for r in packed.collect())


def test_lossless_whole_table_and_any_order(spark):
    r = random.Random(8)
    docs = [(i, [r.randrange(1, 60_000) for _ in range(r.randint(0, 60))]) for i in range(2500)] + [(None, [7, 8, 9]), (None, None), (5, [1] * 40), (5, [1] * 40), (3000, [])]
    frame = lambda rows: spark.createDataFrame([(i, x, 0) for i, x in rows], "doc_id long, ids array<int>, length int")
    got = _rows(packing.pack(frame(docs), size=16, pad=3))
    pieces = [len(x[i : i + 16]) for _, x in docs for i in range(0, len(x or ()), 16)]
    assert Counter(16 - n for *_, n in got) == _one_by_one(pieces, 16)
    found = defaultdict(list)
    for _, ids, parts, starts, matrix, positions, n in got:
        row, at = np.frombuffer(matrix, "<u4").tolist(), np.frombuffer(positions, "<u4").tolist()
        assert len(row) == len(at) == 16 and row[n:] == [3] * (16 - n) and at[n:] == [0] * (16 - n) and starts[-1] == n
        for d, p, a, b in zip(ids, parts, starts[:-1], starts[1:], strict=True):
            found[d, p].append(row[a:b])
            assert at[a:b] == list(range(b - a))
    want = defaultdict(list)
    for d, x in docs:
        for p in range(0, len(x or ()), 16):
            want[d, p // 16].append(x[p : p + 16])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    r.shuffle(docs)
    assert _rows(packing.pack(frame(docs).repartition(5), size=16, pad=3)) == got


def test_empty_table_and_ids_that_do_not_fit(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, ids array<int>")).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        packing.pack(spark.createDataFrame([(1, [70_000])], "doc_id long, ids array<int>"))
    wide = packing.pack(spark.createDataFrame([(1, [70_000])], "doc_id long, ids array<int>"), size=4, width=4).first()
    assert np.frombuffer(wide["input_ids"], "<u4").tolist() == [70_000, 0, 0, 0]


def test_texts_become_the_tokenizer_s_ids(spark):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    texts = [(1, "Some text, and more."), (2, None), (3, ""), (4, "x" * 100_000), (5, "naïve Straße 東京 \U0001f600")]
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in packing.byte_pair_ids(spark.createDataFrame(texts, "doc_id long, text string"), path).collect()}
    encode = packing._byte_pairs(path)
    assert got == {i: encode.encode_ordinary(t or "") for i, t in texts} and all(encode.decode(got[i]) == (t or "") for i, t in texts)
    row = packing.pack_digests(packing.pack(packing.byte_pair_ids(spark.createDataFrame(texts[:1], "doc_id long, text string"), path), size=8)).first()
    assert row["ids_sha256"] == hashlib.sha256(np.array(got[1] + [0] * (8 - len(got[1])), "<u4").tobytes()).hexdigest()
