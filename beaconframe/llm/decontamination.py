"""Benchmark decontamination: BM25 over an inverted index of the test items, with block-max pruning.

The items are the indexed side: postings of each term lie in blocks of items
and each block keeps its largest weight. Every window of every training text is
a query. A window is dropped when the sum of its terms' largest weights cannot
reach the least threshold, then each block whose sum of block maxima cannot
reach the block's; what is left is scored exactly. All items whose score reaches
their threshold are verified: the shingles of their question and of their answer
must lie in the window.

An item's threshold is the least score of a window that passes verification:
each missing word costs a shingle at least, so as many words may be missing as
shingles, and those that weigh most are taken to be. So retrieval loses nothing.

The index goes to the tasks in shards of a fixed number of words, so its size in
memory does not grow with the benchmark; each shard is one pass over the texts.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconframe.llm._text import bounded_batches, encoded, in_slices, starts_of, words_of

#: BM25's saturation and length weights.
K1, B = 1.2, 0.75
#: Items of a block of postings.
BLOCK = 32
#: Share of the shingles of the question, and of the answer, that a window must hold.
OVERLAP = 0.8
#: Words of a shingle.
SHINGLE = 5
#: An item is sought in windows of two steps; its step is the first of LEAST_STEP words, twice that, ... that it fits into.
LEAST_STEP = 128
#: Items that a window with less than this share of their score may hold have an index of their own, so they loosen no other item's bounds.
LOW = 0.2
#: Bounds of (window, block) that are summed at a time.
BOUNDS = 1 << 21
#: Words of the items in one shard of the index (some 200 bytes each in memory).
SHARD_WORDS = 200_000


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the last line is the answer; an item of one line is all question."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    return ("\n".join(lines[:-1]), lines[-1]) if len(lines) > 1 else (lines[0] if lines else "", "")


def _words(text: str) -> list[str]:
    counts, words = words_of(pa.array([text]))
    return words.to_pylist()


def _shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def _part(text: str) -> tuple[int, set[tuple[str, ...]]]:
    """(words of a shingle, shingles) of an item's part; one of fewer than SHINGLE words is a single shingle."""
    words = _words(text)
    size = max(1, min(SHINGLE, len(words)))
    return size, _shingles(words, size)


@dataclass
class Index:
    """The items of one step. `weight` is the share of an item's own score that a term brings; postings are sorted by (term, item).

    A term's blocks, and its largest weight in each, are postings too: from block_start[term] on, in block and block_max.
    """

    terms: dict[str, int]
    start: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    most: np.ndarray
    block_start: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    need: np.ndarray
    block_need: np.ndarray
    ids: list[int]
    whole: list[tuple[int, set]]
    question: list[tuple[int, set]]
    answer: list[tuple[int, set]]
    step: int


def _least_score(weights: list[float], parts: list[list[tuple[int, set]]], overlap: float) -> float:
    """Least share of an item's score that a window has which holds `overlap` of the shingles of all parts of one of the lists."""
    missing = max(sum(len(grams) - math.ceil(overlap * len(grams) - 1e-9) for _, grams in some) for some in parts)
    return max(0.0, 1 - sum(sorted(weights, reverse=True)[:missing]) - 1e-6)


def step_of(n_words: int) -> int:
    """Step of the windows in which an item of so many words is sought; it depends on nothing else."""
    return max(LEAST_STEP, 1 << (n_words - 1).bit_length())


def build_indexes(items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_words: float, overlap: float = OVERLAP) -> list[Index]:
    """One index for each step, and one more for its items of low thresholds. `df` (items that hold each term), `n_items` and `mean_words` are of the whole benchmark, so all shards score alike."""
    groups: dict[tuple[int, bool], list] = {}
    for item_id, text in items:
        words = _words(text)
        if not words:
            continue
        gain = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean_words)) for t, c in Counter(words).items()}
        own = sum(gain.values())
        q, a = split_item(text)
        whole, question, answer = _part(text), _part(q), _part(a)
        need = _least_score([g / own for g in gain.values()], [[whole], [question, answer]], overlap)
        groups.setdefault((step_of(len(words)), need < LOW), []).append((item_id, {t: g / own for t, g in gain.items()}, need, whole, question, answer))
    return [_index(group, step) for (step, _), group in sorted(groups.items())]


def _index(group: list, step: int) -> Index:
    terms: dict[str, int] = {}
    rows = sorted((terms.setdefault(t, len(terms)), n, w) for n, (_, weights, *_) in enumerate(group) for t, w in weights.items())
    term, item, weight = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
    most, need = np.zeros(len(terms)), np.array([g[2] for g in group])
    np.maximum.at(most, term, weight)
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)]))
    block_need = np.full((len(group) - 1) // BLOCK + 1, np.inf)
    np.minimum.at(block_need, np.arange(len(group)) // BLOCK, need)
    count = lambda t: starts_of(np.bincount(t, minlength=len(terms)))
    return Index(terms, count(term), item, weight, most, count(term[first]), item[first] // BLOCK, np.maximum.reduceat(weight, first), need, block_need, [g[0] for g in group], *([g[i] for g in group] for i in (3, 4, 5)), step)


def _share(part: tuple[int, set], words: list[str], found: dict[int, set]) -> float:
    """Share of a part's shingles that `words` hold; `found` keeps the words' shingles by size."""
    size, wanted = part
    if not wanted:
        return 1.0
    if size not in found:
        found[size] = _shingles(words, size)
    return len(wanted & found[size]) / len(wanted)


def _postings(start: np.ndarray, term: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, place) of each posting of the terms."""
    size = start[term + 1] - start[term]
    return np.repeat(slot, size), np.repeat(start[term] - starts_of(size)[:-1], size) + np.arange(size.sum())


def retrieve(index: Index, window: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, score) of all scores that reach the item's threshold; (window, term) pairs are distinct and sorted by window."""
    keep = np.bincount(window, index.most[term], n) >= index.block_need.min(initial=np.inf) - 1e-9
    use = keep[window]
    window, term = window[use], term[use]
    out, blocks = [], len(index.block_need)
    cut = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])) if len(window) else []
    at_once = max(1, min(4096, BOUNDS // blocks))
    for i in range(0, len(cut), at_once):
        a, b = cut[i], cut[i + at_once] if i + at_once < len(cut) else len(window)
        w, t, first = window[a:b], term[a:b], cut[i : i + at_once] - a
        slot = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w))))
        of, at = _postings(index.block_start, t, slot)
        may = np.bincount(of * blocks + index.block[at], index.block_max[at], len(first) * blocks).reshape(-1, blocks) >= index.block_need - 1e-9
        some = may.any(1)[slot]
        if not some.any():
            continue
        slot, at = _postings(index.start, t[some], slot[some])
        item, weight = index.item[at], index.weight[at]
        live = may[slot, item // BLOCK]
        pair, back = np.unique(slot[live] * len(index.ids) + item[live], return_inverse=True)
        score = np.bincount(back, weight[live], len(pair))
        good = score >= index.need[pair % len(index.ids)] - 1e-9
        out.append((w[first][pair[good] // len(index.ids)], pair[good] % len(index.ids), score[good]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _search(shared, overlap: float):
    def work(part: pa.RecordBatch):
        counts, words = words_of(part.column("text"))
        code, values = encoded(words)
        names = values.to_pylist()
        ids, starts = part.column("doc_id").to_pylist(), starts_of(counts)
        row = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(code)) - starts[row]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for index in shared.value:
            _search_index(index, overlap, names, code, counts, starts, row, place, best)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([ids[r] for r, _ in best], pa.int64()),
                "item_id": pa.array([i for _, i in best], pa.int64()),
                **{name: pa.array([round(x[k], 6) for x in best.values()], pa.float64()) for k, name in enumerate(("score", "question_overlap", "answer_overlap"))},
            }
        )

    return in_slices(work, most=1 << 20)


def _search_index(index: Index, overlap: float, names: list[str], code: np.ndarray, counts: np.ndarray, starts: np.ndarray, row: np.ndarray, place: np.ndarray, best: dict) -> None:
    """Enters the best (score, question's and answer's overlap) of each (row, item_id) that passes.

    Windows are two steps long and one step apart, so each stretch of one step's length lies in one of them.
    """
    step, n_terms = index.step, max(1, len(index.terms))
    known = np.array([index.terms.get(v, -1) for v in names], np.int64)
    per = np.maximum(1, (counts + step - 1) // step)
    first = starts_of(per)[:-1]
    term = known[code] if len(code) else code
    hit = term >= 0
    w, term, early = (first[row] + place // step)[hit], term[hit], place[hit] >= step
    w, term = np.concatenate([w, w[early] - 1]), np.concatenate([term, term[early]])
    pairs = np.unique(w * n_terms + term)
    win, item, score = retrieve(index, pairs // n_terms, pairs % n_terms, int(per.sum()))
    for v, i, s in zip(win.tolist(), item.tolist(), score.tolist(), strict=True):
        r = int(np.searchsorted(first, v, side="right")) - 1
        begin = int(starts[r]) + (v - int(first[r])) * step
        held, found = [names[c] for c in code[begin : min(begin + 2 * step, int(starts[r + 1]))]], {}
        q, a = _share(index.question[i], held, found), _share(index.answer[i], held, found)
        if q >= overlap and a >= overlap or _share(index.whole[i], held, found) >= overlap:
            key = r, index.ids[i]
            best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (s, q, a))


def contaminated(df: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): documents of `df` that hold an item of `benchmark`.

    A document holds an item if a window of it, which is two steps long (see
    `step_of`: an item's step depends on its own length only, so other items
    never change what it is found in), has `overlap` or more of the five-word shingles
    of its question and of its answer, or of the item as a whole. A question,
    answer or item of n < 5 words is one shingle of n words. Texts are read whole, A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`. Null or empty
    texts and items hold nothing and are in nothing; a null doc_id or item_id
    is kept; repeated rows are reported once; other columns are ignored,
    whatever their names; empty tables give an empty result.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()

    def shard(batch: list[tuple[int, str]], counts: dict[str, int], n: int, mean: float) -> DataFrame:
        shared = spark.sparkContext.broadcast(build_indexes(batch, counts, n, mean, overlap))
        return docs.mapInArrow(_search(shared, overlap), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")

    size = F.size(F.split("text", r"[\x20\x09-\x0D]+"))
    n, mean = items.agg(F.count("*"), F.avg(size)).first()
    word = items.select("item_id", "text", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([^\\x20\\x09-\\x0D]+)')"))).alias("w"))
    df_of = word.groupBy("w").agg(F.count("*").alias("n"))
    found, batch, held = [], [], 0

    def close() -> None:
        nonlocal batch, held
        if batch:
            own = {w for _, t in batch for w in _words(t)}
            names = spark.createDataFrame([(w,) for w in own], "w string")
            counts = {r["w"]: r["n"] for r in df_of.join(names, "w", "left_semi").toLocalIterator()}
            found.append(shard(batch, counts, n, mean))
        batch, held = [], 0

    for r in items.orderBy("item_id", "text").toLocalIterator(prefetchPartitions=True):  # one shard at a time on the driver
        batch.append((r["item_id"], r["text"]))
        held += len(r["text"].split())
        if held >= shard_words:
            close()
    close()
    if not found:
        return docs.limit(0).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("score", "double"), ("question_overlap", "double"), ("answer_overlap", "double"))])
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")
