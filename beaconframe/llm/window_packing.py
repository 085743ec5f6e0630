"""Order-preserving packing: where the stream of documents is cut into sequences is chosen by dynamic programming.

Documents follow each other in the order of their ids. A cut may lie at a
document's end for nothing, at a sentence's end for SENTENCE and at some other
places for WORD; a sequence of L ids costs its padding (none if L is a power of
two) and SEQUENCE. The cheapest way to reach a cut is

    f(i) = penalty(i) + SEQUENCE + min(min over size >= p(i) - p(j) of f(j) + size - (p(i) - p(j)),
                                       min over p(i) - p(j) = 2^k of f(j))

and as p(i) does not depend on j, the first minimum is that of f(j) + p(j) in a
sliding window: a monotone queue holds it, so each cut enters and leaves once.

The order is cut into shards by the bytes of the texts before a document:
running sums over (id, hash, bytes) give the first document of each shard, so a
shard depends on the table alone, not on how Spark reads or deals it. Texts are
shuffled once, each shard is sorted and streamed, and the program is solved for
blocks of a bounded number of ids. Within the last ids of a block all places
may be cut, so that no block ends in padding.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconframe.llm._text import bounded_batches, encoded, give_back, per_row_sums, slices, split_words, starts_of
from beaconframe.llm.bpe import SETTLED, _lower, _rules, words_in
from beaconframe.operators.state import Scratch

#: Ids of a sequence.
SIZE = 4096
#: What a cut within a document costs, in ids of padding: at a sentence's end, and within one; and what each sequence costs.
SENTENCE, WORD, SEQUENCE = 16, 96, 4
#: A sentence longer than this can be cut after every so many ids.
LONG, EVERY = 256, 64
#: Ids at which a block ends, with the document that reaches them; the last TAIL ids of a block can be cut anywhere.
BLOCK, TAIL = 1 << 20, SIZE
#: Bytes of text in a shard, and the most shards; above that they grow.
SHARD_BYTES, SHARDS = 4 << 20, 50_000
#: Distinct words, with what clings to them, that a worker keeps before it starts anew (some 200 bytes each).
TASK_WORDS = 1_000_000

_CLOSED = re.compile(r"[.!?…。！？][\"'»”’)\]」]*$")
#: Marks that end a sentence without a space behind them, and what follows them.
_FULL_STOPS, _FULL_STOP = ("。", "！", "？"), r"([。！？][^\s\p{L}\p{N}]*)([\p{L}\p{N}])"


@cache
def _merges_alone(path: str):
    """(the merges without normaliser and splitter, for words in the byte alphabet with blanks between; which ids end a word; the byte alphabet)."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    told |= {"normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}
    tokenizer = Tokenizer.from_str(json.dumps(told))
    suffix, n = told["model"]["end_of_word_suffix"], tokenizer.get_vocab_size()
    ends = np.array([(tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(n)])
    # Bytes that are letters of their own in this alphabet; the others follow each other from U+0100 on.
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return tokenizer, ends, {b: chr(256 + i) for i, b in enumerate(others)}


def merge_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each word, all ids) of words as the tokenizer's splitter makes them."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, "<u4")
    tokenizer, ends, alphabet = _merges_alone(path)
    spelt = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(alphabet) for w in words]
    ids = np.concatenate([np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast([" ".join(spelt[i : i + 256]) for i in range(0, len(spelt), 256)], add_special_tokens=False)])
    last = np.flatnonzero(ends[ids])
    assert len(last) == len(words), "each word has one last piece"
    return np.diff(last, prepend=-1), ids


class ChunkEncoder:
    """Ids and sentence ends of texts: what stands between white space is encoded once for all texts that a worker meets, until it knows TASK_WORDS of them."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.size, self.start, self.closed = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)
        self.used = 0

    def _words(self, chunks: list[str]) -> tuple[np.ndarray, list[str]]:
        """(number of words of each chunk, the words), as the tokenizer splits them."""
        joined = "\n".join(chunks) + "\n"
        word = _rules(self.path)[2]
        if "<|" in joined or not (joined.isascii() or SETTLED.fullmatch(joined)):
            each = [words_in(c, self.path) for c in chunks]
            return np.array([len(x) for x in each], np.int64), list(chain.from_iterable(each))
        joined = joined.lower() if joined.isascii() else _lower(unicodedata.normalize("NFC", joined))
        found = _lines(word.pattern).findall(joined)
        breaks = np.array([i for i, w in enumerate(found) if w == "\n"], np.int64)
        return np.diff(breaks, prepend=-1) - 1, [w for w in found if w != "\n"]

    def _learn(self, chunks: list[str]) -> None:
        special = _rules(self.path)[1]
        for i in range(0, len(chunks), 4096):
            some = chunks[i : i + 4096]
            n, words = self._words(some)
            which: dict[str, int] = {}
            code = np.array([which.setdefault(w, len(which)) for w in words], np.int64)
            size, ids = merge_words(["x" if w in special else w for w in which], self.path)
            if not special.keys().isdisjoint(which):  # a special token is one id, as it stands
                at = starts_of(size)
                parts = [np.array([special[w]], "<u4") if w in special else ids[a:b] for w, a, b in zip(which, at[:-1], at[1:], strict=True)]
                size, ids = np.array([len(x) for x in parts], np.int64), np.concatenate(parts)
            of, at = size[code], starts_of(size)[:-1][code]
            flat = ids[np.repeat(at - starts_of(of)[:-1], of) + np.arange(of.sum())]
            self._enter(some, per_row_sums(of, n), flat)

    def _enter(self, chunks: list[str], size: np.ndarray, flat: np.ndarray) -> None:
        a, b = len(self.number), len(self.number) + len(chunks)
        if b > len(self.size):
            self.size, self.start, self.closed = (np.concatenate([x, np.zeros(max(len(x), b), x.dtype)]) for x in (self.size, self.start, self.closed))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), "<u4")])
        self.size[a:b], self.start[a:b] = size, self.used + starts_of(size)[:-1]
        self.closed[a:b] = [not w[-1].isalnum() and _CLOSED.search(w) is not None for w in chunks]
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.number.update(zip(chunks, range(a, b), strict=True))

    def __call__(self, texts: pa.Array, end: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids with the end, ids before each sentence's end within the text) of each text."""
        if len(self.number) > TASK_WORDS:
            self.clear()
        counts, words = split_words(texts)
        index, values = encoded(words)
        if any(pc.any(pc.match_substring(values, c)).as_py() for c in _FULL_STOPS):
            counts, words = split_words(pc.replace_substring_regex(texts, _FULL_STOP, r"\1 \2"))
            index, values = encoded(words)
        names = values.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.number.get, names))
        new = [i for i, n in enumerate(found) if n is None]
        if new:
            self._learn([names[i] for i in new])
            for i in new:
                found[i] = self.number[names[i]]
        code = np.array(found, np.int64)[index]
        size = self.size[code]
        at = starts_of(size)
        ids = self.ids[np.repeat(self.start[code] - at[:-1], size) + np.arange(at[-1])]
        first = starts_of(counts)  # of each text's words
        bounds = at[first]  # of each text's ids
        ids = np.insert(ids, bounds[1:], end).astype("<u4")
        begin = bounds + np.arange(len(bounds))
        closed = np.flatnonzero(self.closed[code])
        places, cut = at[closed + 1], np.searchsorted(closed, first)
        return [(ids[begin[i] : begin[i + 1]], places[cut[i] : cut[i + 1]] - bounds[i]) for i in range(len(counts))]


@cache
def _lines(pattern: str):
    """The word pattern, or the end of a line."""
    return regex.compile(pattern + r"|\n")


@cache
def _encoder(path: str) -> ChunkEncoder:
    """The worker's own, kept for the next task: Spark uses workers again."""
    return ChunkEncoder(path)


def candidates(sizes: list[int], sentences: list[np.ndarray], tail: int = TAIL) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties) of a block's possible cuts, in rising order, from its begin on.

    `sizes` are the documents' ids, `sentences` the places of sentence ends in each.
    """
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    total = int(bounds[-1])
    ends = np.concatenate([bounds, *(b + s for b, s in zip(bounds[:-1], sentences, strict=True))])
    ends = np.unique(ends)
    gap = np.diff(ends)
    wide = np.flatnonzero(gap > LONG)
    inner = [np.arange(ends[i] + EVERY, ends[i + 1], EVERY) for i in wide]
    every = np.unique(np.concatenate([ends, *inner, np.arange(max(0, total - tail), total)]))
    penalty = np.full(len(every), WORD, np.int64)
    penalty[np.searchsorted(every, ends)] = SENTENCE
    penalty[np.searchsorted(every, bounds)] = 0
    return every, penalty


def choose_cuts(place: np.ndarray, penalty: np.ndarray, size: int = SIZE, each: int = SEQUENCE) -> tuple[np.ndarray, int]:
    """(places of the cuts, begin and end included; cost) of the cheapest way from the first to the last place.

    Neighbouring places are `size` apart at most. Of equal ways to a place the one from the earlier place in the window counts, then the longer power of two.
    """
    m = len(place)
    if m < 2:
        return place[:1], 0
    # The places a power of two before each place, as a list of lists cut out of two arrays.
    powers = [1 << k for k in range(size.bit_length()) if 1 << k <= size][::-1]
    number = np.full(int(place[-1] - place[0]) + 1, -1, np.int32)  # of the place at each id
    number[place - place[0]] = np.arange(m)
    to, back = [], []
    for p in powers:
        late = int(np.searchsorted(place, place[0] + p))
        at = number[place[late:] - place[0] - p]
        hit = np.flatnonzero(at >= 0)
        to.append(hit + late)
        back.append(at[hit])
    to, back = np.concatenate(to), np.concatenate(back)
    order = np.argsort(to, kind="stable")
    back = back[order].tolist()
    first = np.searchsorted(to[order], np.arange(m + 1)).tolist()
    where, fine = place.tolist(), penalty.tolist()
    cost, came = [0] * m, [0] * m
    queue, level, head = [0], [where[0]], 0  # places of the window whose cost + place rises
    for i in range(1, m):
        p = where[i]
        while where[queue[head]] < p - size:
            head += 1
        j = queue[head]
        best = level[head] + size - p
        for k in back[first[i] : first[i + 1]]:
            if cost[k] < best:
                best, j = cost[k], k
        cost[i], came[i] = best + fine[i] + each, j
        now = cost[i] + p
        while len(queue) > head and level[-1] >= now:
            queue.pop()
            level.pop()
        queue.append(i)
        level.append(now)
    out, i = [m - 1], m - 1
    while i:
        i = came[i]
        out.append(i)
    return place[np.array(out[::-1])], cost[-1]


_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class _Shard:
    """Documents of one shard as they come; gives the pieces of a block whenever one is full."""

    def __init__(self, size: int):
        self.size, self.shard = size, None

    def open(self, shard: int) -> None:
        self.shard, self.sequences = shard, 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.doc, self.sentences, self.held = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray, sentences: np.ndarray) -> None:
        self.ids.append(ids)
        self.doc.append(doc_id)
        self.sentences.append(sentences)
        self.held += len(ids)

    def pieces(self) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in self.ids], np.int64)
        cuts, _ = choose_cuts(*candidates(sizes.tolist(), self.sentences), self.size)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = np.union1d(cuts, bounds)
        begin, length = at[:-1], np.diff(at)
        doc = np.searchsorted(bounds, begin, side="right") - 1
        sequence = np.searchsorted(cuts, begin, side="right") - 1
        blob = pa.py_buffer(np.concatenate(self.ids).astype("<u4"))
        ids = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((4 * at).astype(np.int32)), blob])
        number = (self.shard << 32) + self.sequences + sequence
        self.sequences += len(cuts) - 1
        out = [pa.array(np.array(self.doc, object)[doc], pa.int64()), begin - bounds[doc], length, sizes[doc], number, begin - cuts[sequence]]
        self.clear()
        return pa.RecordBatch.from_arrays([*(x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in out), ids], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def _packed(path: str, end: int, size: int, block: int):
    """Pieces of texts that come sorted by shard and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held = _encoder(path), _Shard(size)
        for part in slices(batches, most=2 << 20):
            for doc_id, shard, (ids, sentences) in zip(part.column("doc_id").to_pylist(), part.column("shard").to_pylist(), encoder(part.column("text"), end), strict=True):
                if shard != held.shard:
                    if held.shard is not None and held.held:
                        yield held.pieces()
                    held.open(shard)
                held.add(doc_id, ids, sentences)
                if held.held >= block:
                    yield held.pieces()
        if held.shard is not None and held.held:
            yield held.pieces()
        give_back()

    return run


def _shard_starts(docs: DataFrame, table: Scratch, shard_bytes: int, shards: int) -> np.ndarray:
    """The keys (doc_id or the smallest long, hash) of the first documents of shards, in order: rows of a matrix, `shards` at most."""
    sizes = docs.select("key", "h", (F.octet_length("text") + 16).alias("n")).groupBy("key", "h").agg(F.sum("n").alias("n"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = table(sizes.repartitionByRange(parts, "key", "h").withColumn("p", F.spark_partition_id()), "sizes")
    before, sums = 0, []
    for r in sizes.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect():  # one row for each of the shuffle's partitions
        sums.append((r["p"], before))
        before += r["n"]
    if not sums:
        return np.zeros((0, 2), np.int64)
    each = max(shard_bytes, -(-before // shards))
    offset = F.broadcast(docs.sparkSession.createDataFrame(sums, "p int, before long"))
    within = F.sum("n").over(Window.partitionBy("p").orderBy("key", "h")) - F.col("n")
    at = sizes.withColumn("at", within).join(offset, "p").withColumn("shard", F.expr(f"(before + at) div {each}"))
    first = at.groupBy("shard").agg(F.min(F.struct("key", "h")).alias("x")).select("shard", "x.key", "x.h").orderBy("shard").collect()
    return np.array([(r["key"], r["h"]) for r in first], np.int64).reshape(-1, 2)


def shard_of(key: np.ndarray, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of the last shard that begins at (key, h) or before."""
    low, high = np.searchsorted(starts[:, 0], key, side="left"), np.searchsorted(starts[:, 0], key, side="right")
    out = high.copy()
    for i in np.flatnonzero(high > low):  # shards that begin within rows of one id
        out[i] = low[i] + np.searchsorted(starts[low[i] : high[i], 1], h[i], side="right")
    return np.maximum(out - 1, 0)


def pack_in_order(df: DataFrame, path: str, end: int = 2, size: int = SIZE, block: int = BLOCK, shard_bytes: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of all documents in sequences of at most `size` ids.

    A document is its text's ids by the tokenizer of the file `path`, then the
    id `end`; `ids` are a piece's ids as little-endian unsigned 32-bit integers,
    `start` how many of its document come before it, `offset` how many of its
    sequence. Sequences are numbered in the order of the documents, which is
    that of their ids, rows without one first, then of a hash of their text;
    numbers have gaps between shards. A null text counts as empty and is the end alone; a
    null doc_id is kept; repeated rows are packed each; other columns are
    ignored, whatever their names; an empty table gives an empty result. Rows
    equal in id and text are in one shard, all others are dealt by size.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")), "h": F.xxhash64("text")})
    with Scratch(spark) as table:
        starts = _shard_starts(docs, table, shard_bytes, SHARDS)
    shared = spark.sparkContext.broadcast(starts)  # SHARDS rows at most

    @F.pandas_udf("int")
    def shard(key: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(shard_of(key.to_numpy(np.int64), h.to_numpy(np.int64), shared.value).astype(np.int32))

    dealt = docs.withColumn("shard", shard("key", "h")).repartitionById(max(1, len(starts)), F.col("shard")).sortWithinPartitions("shard", "key", "h", "doc_id")
    return dealt.select("doc_id", "text", "shard").mapInArrow(_packed(path, end, size, block), _PIECES)


def sequence_rows(pieces: DataFrame, size: int = SIZE, pad: int = 0) -> DataFrame:
    """(sequence_id, doc_ids, cu_seqlens, input_ids, n_tokens): one row for each sequence of `pack_in_order`.

    input_ids are little-endian 32-bit integers, filled up to `size` with `pad`
    unless their number is a power of two; a sequence holds `size` pieces at most.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_tokens"))
    whole = F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")
    fill = F.when(F.bit_count("n_tokens") == 1, F.lit(0)).otherwise(F.lit(size) - F.col("n_tokens")).cast("int")
    word = F.hex(F.lit(pad.to_bytes(4, "little")))
    starts = F.concat(F.transform("p", lambda x: x["offset"]), F.array("n_tokens"))
    return rows.select("sequence_id", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), starts.alias("cu_seqlens"), F.unhex(F.concat(whole, F.repeat(word, fill))).alias("input_ids"), "n_tokens")


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
