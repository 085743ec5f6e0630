"""Maximal periodic runs of words, by branching tandem repeats on an enhanced suffix array.

A run of period q ends in exactly one square ww, |w| = q, whose next word
differs from the first of its second half. Its two halves start suffixes that
share q words and no more: they lie in different children of one LCP interval
of depth q. So for each interval the suffixes of all children but the largest
look in the inverse suffix array whether the suffix q words before or after
them is in the interval, in another child. Each square found so is rotated to
the left as far as words repeat, and what comes out are the runs.

Suffixes are sorted by doubling. The classes of equal stretches of 1, 2, 4 ...
words that this makes on the way also answer how long two places agree, to the
right for the LCP values and to the left for the rotation. Words are numbered
apart in each document, so one array serves many documents and no stretch
leaves its own. Documents in which no six words repeat have no run of twelve
words and are passed over before anything is sorted by more.

Each text is worked on where it is read; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconframe.llm._text import bounded_batches, encoded, in_slices, mix, split_words, starts_of

#: Fewest words of a run.
LEAST = 12
#: Text bytes that a task looks at together.
SLICE = 2 << 20


def _repeats(codes: np.ndarray, doc: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """For each document whether `length` words of it may occur twice (never false where they do)."""
    out = np.zeros(n_docs, bool)
    n = len(codes) - length + 1
    if n < 2:
        return out
    with np.errstate(over="ignore"):
        salt = mix(codes.astype(np.uint64) + np.uint64(1))
        key = mix(doc[:n].astype(np.uint64) + np.uint64(1 << 40))
        for i in range(length):
            key = key * np.uint64(0x9E3779B97F4A7C15) + salt[i : i + n]
    inside = doc[:n] == doc[length - 1 :]
    key, whose = mix(key[inside]), doc[:n][inside]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out[whose[order[1:][same]]] = True
    return out


def suffix_classes(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, classes): classes[l][i] is equal for places with equal stretches of 2**l words, cut at the document's end.

    `ends` has the end of each place's document; codes of different documents
    must differ. A class is named by its first place in the suffix array, so
    the last classes are the inverse suffix array.
    """
    n = len(codes)
    sa = np.argsort(codes, kind="stable")
    new = np.concatenate([[True], codes[sa][1:] != codes[sa][:-1]]) if n else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    classes, step = [rank.astype(np.int32)], 1
    while True:
        alone = new & np.concatenate([new[1:], [True]])
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return sa, classes
        p = sa[open_]
        next_ = p + step
        inside = next_ < ends[p]
        second = np.where(inside, rank[np.minimum(next_, n - 1)] + 1, 0)
        key = rank[p] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        p, key = p[order], key[order]
        sa[open_] = p  # open places are whole classes, each in its own range
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[open_] = fresh
        rank[p] = np.maximum.accumulate(np.where(fresh, open_, 0))
        classes.append(rank.astype(np.int32))
        step *= 2


def _agree(classes: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words agree from places a and b on (a different from b)."""
    n, at, to = len(classes[0]), a.copy(), b.copy()
    for level in range(len(classes) - 1, -1, -1):
        c = classes[level]
        same = (at < n) & (to < n)
        same &= c[np.minimum(at, n - 1)] == c[np.minimum(to, n - 1)]
        at += same * (1 << level)
        to += same * (1 << level)
    return at - a


def _agree_left(classes: list[np.ndarray], begin: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words agree before places a < b, none of them before `begin`."""
    at, gap = a.copy(), b - a
    for level in range(len(classes) - 1, -1, -1):
        c, k = classes[level], 1 << level
        there = at - k >= begin
        same = there & (c[np.maximum(at - k, 0)] == c[np.maximum(at - k, 0) + gap])
        at -= same * k
    return a - at


def _nearest_smaller(lcp: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the last earlier and the first later one that is smaller (0 and the length if none)."""
    n = len(lcp)
    left, right, stack = [0] * n, [n] * n, []
    for k, depth in enumerate(lcp):
        while stack and lcp[stack[-1]] > depth:
            right[stack.pop()] = k
        # An equal one belongs to the same interval and shares its left end.
        left[k] = (left[stack[-1]] if lcp[stack[-1]] == depth else stack[-1]) if stack else 0
        stack.append(k)
    return np.array(left, np.int64), np.array(right, np.int64)


def branching_squares(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(start, period, classes) of each square ww whose next word is not w's first, in any order, each once."""
    sa, classes = suffix_classes(codes, ends)
    n = len(codes)
    isa = classes[-1].astype(np.int64)
    lcp = np.concatenate([[0], _agree(classes, sa[:-1], sa[1:])]) if n else np.zeros(0, np.int64)
    left, right = _nearest_smaller(lcp.tolist())
    # Right ends of equal entries: the last of them has the true one, the others end there too.
    cuts = np.flatnonzero(lcp > 0)
    if not len(cuts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), classes
    # An interval is left[k] .. right[k]-1 of the suffix array; its cuts are the entries of its depth.
    order = cuts[np.lexsort((cuts, lcp[cuts], left[cuts]))]
    head = np.concatenate([[True], (left[order][1:] != left[order][:-1]) | (lcp[order][1:] != lcp[order][:-1])])
    which = np.cumsum(head) - 1
    heads = np.flatnonzero(head)
    lo, depth = left[order][heads], lcp[order][heads]
    hi = np.maximum.reduceat(right[order], heads)
    # Children: from lo to the first cut, between cuts, from the last cut to hi.
    child_from = np.concatenate([order, lo])
    child_of = np.concatenate([which, np.arange(len(heads))])
    s = np.lexsort((child_from, child_of))
    child_from, child_of = child_from[s], child_of[s]
    last = np.concatenate([child_of[1:] != child_of[:-1], [True]])
    child_to = np.where(last, hi[child_of], np.concatenate([child_from[1:], [0]]))
    size = child_to - child_from
    # All but the (first) largest child of each interval.
    begin = np.flatnonzero(np.concatenate([[True], child_of[1:] != child_of[:-1]]))
    most = np.maximum.reduceat(size, begin)[child_of]
    largest = size == most
    ahead = np.cumsum(largest)
    largest &= ahead == (ahead[begin] - largest[begin])[child_of] + 1
    small = np.flatnonzero(~largest)
    size = size[small]
    at = np.repeat(child_from[small] - starts_of(size)[:-1], size) + np.arange(size.sum())
    of = np.repeat(small, size)
    p, d = sa[at], depth[child_of[of]]
    lo, hi, own_lo, own_hi = lo[child_of[of]], hi[child_of[of]], child_from[of], child_to[of]
    found = []
    for q in (p + d, p - d):
        there = (q >= 0) & (q < n)
        r = isa[np.clip(q, 0, n - 1)]
        there &= (r >= lo) & (r < hi) & ((r < own_lo) | (r >= own_hi))
        found.append(np.stack([np.minimum(p, q)[there], d[there]], 1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1], classes


def find_runs(codes: np.ndarray, counts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of every run, in order of document, start and period.

    `codes` are the words of documents of `counts` words each. A run is a
    stretch of `least` words or more, and of two smallest periods or more, that
    neither neighbouring word extends with that period. Starts count from the
    document's first word.
    """
    doc = np.repeat(np.arange(len(counts)), counts)
    # A run of L >= max(least, 2q) words has L - q that occur again q words on.
    kept = _repeats(codes, doc, len(counts), max(1, least // 2)) if len(codes) else np.zeros(len(counts), bool)
    rows = kept[doc] if len(codes) else np.zeros(0, bool)
    none = np.zeros(0, np.int64)
    if not rows.any():
        return none, none, none, none
    numbers = np.flatnonzero(kept)
    size = counts[numbers]
    begins = starts_of(size)
    which = np.repeat(np.arange(len(numbers)), size)
    begin, ends = begins[:-1][which], begins[1:][which]
    apart = which.astype(np.int64) * (int(codes.max()) + 1) + codes[rows]
    start, period, classes = branching_squares(apart, ends)
    if not len(start):
        return none, none, none, none
    back = _agree_left(classes, begin[start], start, start + period)
    first, length = start - back, back + 2 * period
    long = length >= least
    first, length, period = first[long], length[long], period[long]
    # One stretch found with several periods has the smallest of them.
    order = np.lexsort((period, length, first))
    first, length, period = first[order], length[order], period[order]
    one = np.concatenate([[True], (first[1:] != first[:-1]) | (length[1:] != length[:-1])]) if len(first) else np.zeros(0, bool)
    first, length, period = first[one], length[one], period[one]
    order = np.lexsort((period, first))
    first, length, period = first[order], length[order], period[order]
    return numbers[which[first]], first - begin[first], length, period


def periodic_words(counts: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Which word stands at each place of documents of `counts` words once the documents whose seed is divisible by ten are made periodic.

    With g = seed // 10, words from a = g % n on repeat p = 1 + (n - a) //
    (3 + g % 8) words. A negative seed leaves its document as it is.
    """
    begins = starts_of(counts)[:-1]
    n = np.maximum(counts, 1)
    g = np.maximum(seed, 0) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    a = np.where((seed >= 0) & (seed % 10 == 0), a, counts)
    within = np.arange(counts.sum()) - np.repeat(begins, counts)
    a, p = np.repeat(a, counts), np.repeat(p, counts)
    return np.repeat(begins, counts) + np.where(within >= a, a + (within - a) % p, within)


def _work(least: int):
    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, words = split_words(part.column("text"))
        seed = part.column("seed").to_numpy(zero_copy_only=False)
        codes = encoded(words)[0]
        if (seed >= 0).any() and len(words):
            place = periodic_words(counts, seed)
            words, codes = words.take(pa.array(place)), codes[place]
        doc, start, length, period = find_runs(codes, counts, least)
        n = len(counts)
        begins = starts_of(counts)
        gone = np.zeros(len(codes) + 1, np.int64)
        np.add.at(gone, begins[doc] + start + period, 1)
        np.add.at(gone, begins[doc] + start + length, -1)
        kept = np.cumsum(gone)[:-1] == 0
        if not kept.all():
            words = words.filter(pa.array(kept))
        left = np.bincount(np.repeat(np.arange(n), counts)[kept], minlength=n)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts_of(left).astype(np.int32)), words), pa.scalar(" ", words.type))
        bounds = np.searchsorted(doc, np.arange(n + 1))
        runs = [None if a == b else [{"start": s, "length": l, "period": q} for s, l, q in zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x or [] for x in runs], kind), text.cast(pa.string()), pa.array(counts)], ["doc_id", "runs", "collapsed", "n_words"])

    return work


def periodic_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: Column | None = None, least: int = LEAST) -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>, collapsed, n_words) of each text.

    Words are what stands between ASCII white space. Runs come by start, then
    period. `collapsed` has the words, a space apart, without those that some
    run holds after its first `period` words. Where `seed` is given, documents
    are made periodic first as `periodic_words` says; a null seed leaves them. A
    null text counts as empty, an empty one has no words and no runs; a null
    doc_id is kept; repeated rows are treated each; other columns are ignored,
    whatever their names; an empty table gives an empty result. A task holds
    one text of any length, or several of two megabytes together.
    """
    bounded_batches(df.sparkSession)
    seed = F.lit(-1) if seed is None else F.coalesce(seed, F.lit(-1))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), seed.cast("long").alias("seed"))
    return rows.mapInArrow(in_slices(_work(least), most=SLICE), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string, n_words long")


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; nulls if none) with its exponent in thousandths, and SHA-256 of all runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("x", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("x.s").alias("start"),
        (-F.col("x.l")).alias("length"),
        F.col("x.p").alias("period"),
        F.expr("(1000 * -x.l) div x.p").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
