"""Packing in order: the cheapest cuts by trying all, ids by the tokenizer library, and what pieces must keep."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconframe.llm import window_packing as W
from beaconframe.llm.bpe import _tokenizer
from beaconframe.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def _cheapest(place, penalty, size, each):
    cost = [0] + [None] * (len(place) - 1)
    for i in range(1, len(place)):
        ways = [cost[j] + (0 if n & (n - 1) == 0 else size - n) for j in range(i) if 0 < (n := place[i] - place[j]) <= size and cost[j] is not None]
        cost[i] = min(ways) + penalty[i] + each if ways else None
    return cost[-1]


@pytest.mark.parametrize("seed", range(60))
def test_cuts_cost_as_little_as_any(seed):
    r = random.Random(seed)
    size = r.choice([8, 16, 64])
    place = [0]
    while len(place) < r.randint(2, 120):
        place.append(place[-1] + r.randint(1, r.choice([2, size // 2, size])))
    penalty = [r.choice([0, 0, 3, 9]) for _ in place]
    cuts, cost = W.choose_cuts(np.array(place), np.array(penalty), size, 2)
    assert cost == _cheapest(place, penalty, size, 2)
    length = np.diff(cuts).tolist()
    at = dict(zip(place, penalty, strict=True))
    assert cuts[0] == 0 and cuts[-1] == place[-1] and max(length) <= size
    assert cost == sum((0 if n & (n - 1) == 0 else size - n) + 2 for n in length) + sum(at[c] for c in cuts[1:].tolist())


def _check(rows, docs, size=4096, end=2):
    """Each id in one piece, ids as the library has them, sequences gapless; returns (ids, padding)."""
    tokenizer = _tokenizer(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc_id, start, length, tokens, sequence, offset, ids in rows:
        assert len(ids) == 4 * length > 0
        by_doc[doc_id].append((start, length, tokens, bytes(ids)))
        by_sequence[sequence].append((offset, length))
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4").tobytes())
    assert by_doc.keys() == want.keys()
    for i, texts in want.items():
        pieces = sorted(by_doc[i])
        assert sum(p[1] for p in pieces) == sum(len(t) // 4 for t in texts)
        if len(texts) == 1:
            at = 0
            for start, length, tokens, _ in pieces:
                assert start == at and tokens == len(texts[0]) // 4
                at += length
            assert b"".join(p[3] for p in pieces) == texts[0]
    total = padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= size
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else size - at)
    return total, padding


def _documents(seed, n=300):
    r = random.Random(seed)
    words = ["the", "Straße", "naïve", "it's", "东京。大阪！京都", "x<|endoftext|>y", "42", "3.14", "end.", "so?", "(yes!)", "…", "ΑΣ", "a\x1cb", " ", "ét", "one_two"]
    return [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 60, 700])))) for i in range(n)]


def test_lossless_ids_of_the_library_and_little_padding(spark):
    docs = _documents(1) + [(1000, None), (1001, ""), (1002, "word " * 30_000), (1003, "z" * 20_000), (None, "no id."), (None, "none either"), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, shard int, ids string")
    rows = [tuple(r) for r in W.pack_in_order(df, PATH, block=1 << 14, shard_bytes=100_000).collect()]
    total, padding = _check(rows, docs)
    assert padding <= total / 200
    again = {tuple(r) for r in W.pack_in_order(df.repartition(7), PATH, block=1 << 14, shard_bytes=100_000).collect()}
    assert again == set(rows)
    digests = W.piece_digests(W.pack_in_order(df, PATH)).where("doc_id = 1000").collect()
    assert [tuple(x)[:5] for x in digests] == [(1000, 0, 1, zlib.crc32(np.array([2], "<u4").tobytes()), 1)]


def test_order_of_documents_is_kept(spark):
    docs = _documents(2, 80)
    rows = W.pack_in_order(spark.createDataFrame(docs[::-1], "doc_id long, text string"), PATH, block=4096, shard_bytes=20_000).orderBy("sequence_id", "offset").collect()
    assert len({r["sequence_id"] >> 32 for r in rows}) > 1
    stream = [(r["doc_id"], r["start"]) for r in rows]
    assert stream == sorted(stream)


def test_rows_of_sequences(spark):
    pieces = W.pack_in_order(spark.createDataFrame(_documents(3, 60), "doc_id long, text string"), PATH)
    want = defaultdict(list)
    for r in pieces.collect():
        want[r["sequence_id"]].append((r["offset"], r["doc_id"], bytes(r["ids"])))
    for r in W.sequence_rows(pieces, pad=9).collect():
        parts = sorted(want.pop(r["sequence_id"]))
        ids = b"".join(p[2] for p in parts)
        n = len(ids) // 4
        full = n if n & (n - 1) == 0 else 4096
        assert bytes(r["input_ids"]) == ids + np.full(full - n, 9, "<u4").tobytes()
        assert r["doc_ids"] == [p[1] for p in parts] and r["cu_seqlens"] == [p[0] for p in parts] + [n] and r["n_tokens"] == n
    assert not want


def test_empty_table_and_one_short_text(spark):
    assert W.pack_in_order(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    rows = [tuple(r) for r in W.pack_in_order(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string"), PATH).collect()]
    assert _check(rows, [(1, "a b c d")]) == (5, 0)


def test_shards_begin_within_rows_of_one_id():
    starts = np.array([(0, 5), (3, 10), (3, 20), (9, 0)], np.int64)
    key, h = np.array([-5, 0, 3, 3, 3, 4, 9, 9]), np.array([0, 5, 9, 10, 25, 0, -1, 0])
    assert W.shard_of(key, h, starts).tolist() == [0, 0, 0, 1, 2, 2, 2, 3]
