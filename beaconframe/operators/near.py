"""The first few others near in time, for each row that asks, without making the pairs.

A window of time reaches from some moment of one block, as long as the window,
to the same moment of the next one. So what a row asks for is the first of what
follows in one block and of what went before in the next; both are kept up to
date while a block's rows pass once in order of time, one way and the other.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_of(*parts: Column) -> Column:
    """One text of several, none of them null; equal only if all parts are."""
    return F.concat(*(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts))


def _passing(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, block, asking, n, tag, label) in order of key, block and time to the first `k` numbers of other tags at each asking one."""

    def needed(kept: list[tuple[int, str]]) -> list[tuple[int, str]]:
        """Of the rows (number, tag) in order those that may be among the first `k` of other tags than some tag; 2 `k` at most."""
        out, count = [], Counter()
        for n, tag in kept:
            if len(out) < k or len(out) - max((c for t, c in count.items() if t != tag), default=0) < k:
                out.append((n, tag))
                count[tag] += 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, most = None, [], None
        for b in batches:
            told: tuple[list, list, list] = ([], [], [])
            for key, block, asking, n, tag, label in zip(*(b.column(c).to_pylist() for c in ("key", "block", "asking", "n", "tag", "label")), strict=True):
                if (key, block) != at:
                    at, kept, most = (key, block), [], None
                if asking:
                    found = list(islice((m for m, t in kept if t != tag), k))
                    if found:
                        for column, x in zip(told, (n, label, found), strict=True):
                            column.append(x)
                elif most is None or n < most:
                    insort(kept, (n, tag))
                    if len(kept) >= 4 * k:
                        kept = needed(kept)
                        # Where `k` rows are of other tags than any one, no later number is needed.
                        if len(kept) - max(Counter(t for _, t in kept).values()) >= k:
                            most = kept[-1][0]
            yield pa.RecordBatch.from_arrays([pa.array(told[0], pa.int64()), pa.array(told[1], pa.int32()), pa.array(told[2], pa.list_(pa.int64()))], ["n", "label", "others"])

    return run


def first_near(rows: DataFrame, width: int, k: int) -> DataFrame:
    """(n, label, others): for each of the rows (key, n, tag, t, label) with a label the `k` smallest numbers of rows of its key, but of another tag, whose times are `width` micros apart at most.

    Up to two rows with `k` numbers each, some of which go beyond the `k`
    smallest of both. Nothing but `label` may be null.
    """
    t, block = F.col("t"), lambda x: F.floor(x / F.lit(2 * width))
    point = lambda way, x, order: F.struct(F.lit(0).alias("asking"), (block(x) * 2 + way).alias("block"), order.alias("place"))
    ask = lambda way, x, order: F.struct(F.lit(1).alias("asking"), (block(x) * 2 + way).alias("block"), order.alias("place"))
    every = [point(0, t, t), point(1, t, -t)]
    asked = [ask(0, t + width, t + width), ask(1, t - width, width - t)]
    sent = rows.withColumn("x", F.explode(F.when(F.col("label").isNull(), F.array(*every)).otherwise(F.array(*every, *asked))))
    sent = sent.select("key", "x.block", "x.place", "x.asking", F.col("n").cast("long").alias("n"), F.col("tag").cast("string").alias("tag"), F.col("label").cast("int").alias("label")).withColumn("h", F.xxhash64("key", "block"))
    ordered = sent.repartition("h").sortWithinPartitions("h", "key", "block", "place", "asking")
    return ordered.select("key", "block", "asking", "n", "tag", "label").mapInArrow(_passing(k), "n long, label int, others array<long>")


def smallest(numbers: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(numbers)), 1, k)


def ends(edges: DataFrame) -> DataFrame:
    """(node, ends) of edges (a, b, type, weight) in both directions, where nodes have few: structs (w, other, type), w the negative weight."""
    end = lambda x, y: edges.select(F.col(x).alias("node"), F.struct((-F.col("weight")).alias("w"), F.col(y).alias("other"), "type").alias("e"))
    return end("a", "b").union(end("b", "a").where("node <> e.other")).groupBy("node").agg(F.collect_list("e").alias("ends"))


def ranked_ends(lists: DataFrame, k: int) -> DataFrame:
    """(node, other, type, weight, rank): of each node's `ends` the `k` of the largest weight; ties by number and type."""
    top = lists.select("node", F.slice(F.array_sort("ends"), 1, k).alias("ends"))
    return top.select("node", F.posexplode("ends").alias("i", "e")).select("node", "e.other", "e.type", (-F.col("e.w")).alias("weight"), (F.col("i") + 1).alias("rank"))
