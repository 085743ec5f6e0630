"""Arrow and numpy helpers that the text operators run inside Spark tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Most text bytes that a task holds as words at a time.
SLICE_BYTES = 4 << 20
#: Bytes at which a batch of rows between Spark and Python ends (one row at least), besides the bound on its rows.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on batches of this session are bounded by BATCH_BYTES: ten thousand long texts are no batch."""
    spark.conf.set(_BATCH, str(BATCH_BYTES))


def give_back() -> None:
    """Returns memory that this worker has freed to the machine: Spark keeps idle workers, and others run beside them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in order, in pieces of about `most` bytes of `column` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.take(pa.array(np.arange(at, to)))  # a copy of its own: kernels mishandle the offsets of slices
            at = to


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+`: (number of words of each row, all words). Null counts as empty."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    words = lists.flatten()
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    there = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not there.all():
        rows = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(rows[there], minlength=len(counts)).astype(np.int64)
        words = words.filter(pa.array(there))
    return counts, words


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """`split_words` with A-Z lower-cased."""
    return split_words(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))


def encoded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(index of each word's value, distinct values)."""
    if not len(words):
        return np.zeros(0, np.int64), words
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, equal on every machine."""
    if not len(values):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well spread bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums, one longer than `counts`."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def per_row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each row's values, rows having `counts` values each; 0 for none."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    at = starts_of(counts)
    return sums[at[1:]] - sums[at[:-1]]


def in_slices(work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], column: str = "text", most: int = SLICE_BYTES):
    """A mapInArrow function that gives `work` one bounded slice of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, most):
            yield from work(part)
        give_back()

    return run
