"""Free-text search by postings of three letters: what a query reads grows with its rarest letters, not with the table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that postings are dealt to by their letters unless told otherwise, and how many of a query's rarest letters are intersected.
BUCKETS, RAREST = 256, 4
_SEPARATOR = "\x1f"


def searched(fields: list[str]) -> Column:
    """The text that a search looks into: the fields in lower case."""
    return F.lower(F.concat_ws(_SEPARATOR, *fields))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


#: Bytes of text, one text at least, whose postings a task makes at a time.
CHUNK = 1 << 21
#: Bytes that a batch of texts to a task may have in this session.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) of about CHUNK bytes of text at a time, from one or more batches."""
    held, size = [], 0
    for batch in batches:
        ends, at = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)), 0
        while at < len(ends):
            room = CHUNK - size + (ends[at - 1] if at else 0)
            to = int(np.searchsorted(ends, room, side="right"))
            to = max(to, at + (not held))
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1] - (ends[at - 1] if at else 0))
            at = to
            if at < len(ends):
                yield from _joined(held)
                held, size = [], 0
    yield from _joined(held)


def _joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_batches(held).combine_chunks().to_batches() if held else ()


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, keys): of each chunk of texts the stretches of three letters, and the keys of the texts that hold them, each once."""
    for part in _chunks(batches):
        text = part.column("text").cast(pa.large_string())
        size = pc.utf8_length(text).to_numpy().astype(np.int64)
        letters = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), "<u4")
        seen = np.zeros(1 << 21, bool)
        seen[letters] = True
        alphabet, code = np.flatnonzero(seen), (np.cumsum(seen) - 1)[letters]
        row, n, rows = np.repeat(np.arange(part.num_rows), size), len(alphabet), part.num_rows
        first = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
        if not len(first):
            continue
        grams, row = (code[first] * n + code[first + 1]) * n + code[first + 2], row[first]  # below 2^63, as there are fewer than 2^21 letters
        if n**3 * rows < 1 << 63:
            both = np.unique(grams * rows + row)
            kinds, size = np.unique(both // rows, return_counts=True)
        else:
            kinds, number = np.unique(grams, return_inverse=True)
            both = np.unique(number * rows + row)
            size = np.bincount(both // rows)
        row = both % rows
        spelt = alphabet[np.stack([kinds // (n * n), kinds // n % n, kinds % n], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
        names = pa.array([spelt[i : i + 3] for i in range(0, len(spelt), 3)])
        ends = np.append(0, np.cumsum(size)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(ends), part.column("key").take(pa.array(row)))], ["gram", "keys"])


class PostingIndex:
    """Postings of a table's fields in a folder, in `buckets` folders by gram, and the keys that are entered.

    A row has a gram and the keys of those texts of a chunk that hold it. The number of folders stays as it was when the first rows were entered. Keys are unique and not null; rows whose key is known are not entered again.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, fields: list[str], kind: str = "long", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.fields, self.kind, self.buckets = spark, path.rstrip("/"), key, fields, kind, buckets

    def _read(self, name: str, schema: str) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def keys(self) -> DataFrame:
        return self._read("keys", f"key {self.kind}")

    def postings(self) -> DataFrame:
        """(gram, bucket, key)."""
        return self._lists().select("gram", "bucket", F.explode("keys").alias("key"))

    def _lists(self) -> DataFrame:
        return self._read("postings", f"gram string, keys array<{self.kind}>, bucket int")

    def update(self, df: DataFrame) -> None:
        """Enters the rows of `df` whose key is not entered yet. Postings go first, so a broken update is entered again; a posting that is there twice changes nothing."""
        self.spark.conf.set(_BATCH, str(CHUNK))
        new = df.where(F.col(self.key).isNotNull()).select(F.col(self.key).alias("key"), searched(self.fields).alias("text")).join(self.keys(), "key", "left_anti")
        rows = new.select(F.col("key").cast(self.kind), "text").mapInArrow(_posted, f"gram string, keys array<{self.kind}>").withColumn("bucket", _bucket(F.col("gram"), self.buckets))
        # Rows of a bucket are dealt on by a key of theirs, so that common letters are no single task's.
        rows.repartition("bucket", F.pmod(F.xxhash64(F.col("keys")[0]), F.lit(8))).sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        new.select("key").write.mode("append").parquet(f"{self.path}/keys")

    def candidates(self, query: str) -> DataFrame | None:
        """(key) of the rows that hold the query's RAREST rarest letters, from the folders of the query's letters alone; None if the query has fewer than three letters."""
        wanted = query.strip().lower()
        grams = sorted({wanted[i : i + 3] for i in range(len(wanted) - 2)})
        if not grams:
            return None
        folders = [r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"), self.buckets)).distinct().collect()]
        own = self._lists().where(F.col("bucket").isin(folders) & F.col("gram").isin(grams))
        counts = {r["gram"]: r["n"] for r in own.groupBy("gram").agg(F.sum(F.size("keys")).alias("n")).collect()}  # as many rows as the query has letters
        if len(counts) < len(grams):
            return own.select(F.explode("keys").alias("key")).limit(0)
        rarest = sorted(grams, key=lambda g: (counts[g], g))[:RAREST]
        hits = own.where(F.col("gram").isin(rarest)).select("gram", F.explode("keys").alias("key"))
        return hits.groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rarest)).select("key")

    def search(self, df: DataFrame, query: str) -> DataFrame:
        """The rows of `df`, all of whose keys are entered, that hold the query in one of the fields, whatever the case; a blank query keeps all, one of one or two letters is a scan."""
        wanted = query.strip().lower()
        if not wanted:
            return df
        some = self.candidates(query)
        near = df if some is None else df.join(some.withColumnRenamed("key", self.key), self.key, "left_semi")
        return near.where(F.contains(searched(self.fields), F.lit(wanted)))
