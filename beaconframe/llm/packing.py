"""Token-id output: best-fit-decreasing packing of whole tables into rows of a fixed length.

Texts become ids and documents longer than a row are split without loss. Best
fit only needs the pieces' lengths, and of a length only how many there are:
the packing of the whole table is solved on that histogram (as many entries as
a row has ids), longest first, each piece into the fullest row that still has
room, which a segment tree over the rooms finds. Its result is a table of runs:
so many pieces of one length go to so many rows, so many to each. Pieces are
numbered within their length, look their row up in the runs, and their ids are
then dealt to the rows and laid out as matrices of little-endian integers.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconframe.llm._text import in_slices
from beaconframe.operators.state import Scratch, materialize

#: Ids of a row.
ROW = 2048
#: Numbers of pieces (of one length, in one partition) up to which their table is broadcast; more are joined by a shuffle.
BROADCAST_STARTS = 1_000_000
#: Pieces that a task lays out at a time.
PIECES = 1_000


class _Rooms:
    """Segment tree over capacities 1..size: how many open rows have each; finds the least capacity that fits."""

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.count = [0] * (2 * self.n)

    def add(self, room: int, by: int) -> None:
        i = self.n + room
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, need: int) -> int:
        """The smallest room of `need` or more that an open row has; -1 if none."""
        i = self.n + need
        if self.count[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return -1


def best_fit_runs(pieces: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first, n, row, per): pieces first..first+n of a length go to the rows from `row` on, `per` to each.

    `pieces` says how many pieces there are of each length. Equal to best fit
    of the pieces one by one: a row that is the fullest with room for one piece
    stays so for the next of that length, until it is too full.
    """
    rooms, open_rows, runs, rows = _Rooms(size), {}, [], 0

    def opened(room: int, start: int, n: int) -> None:
        if room and n:
            open_rows.setdefault(room, []).append((start, n))
            rooms.add(room, n)

    for length in sorted(pieces, reverse=True):
        done, left = 0, pieces[length]
        while left:
            room = rooms.least(length)
            if room < 0:
                room, start, n = size, rows, -(-left // (size // length))
                rows += n
            else:
                start, n = open_rows[room].pop()
                rooms.add(room, -n)
            per = room // length
            use = min(n, left // per)
            if not use:
                use, per = 1, left
            runs.append((length, done, use * per, start, per))
            done, left = done + use * per, left - use * per
            opened(room - per * length, start, use)
            if room < size or not left:
                opened(room, start + use, n - use)
            elif n > use:  # new rows that these pieces will fill on
                runs.append((length, done, left, start + use, left))
                opened(size - left * length, start + use, 1)
                left = 0
    return runs


@cache
def _byte_pairs(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_pair_ids(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): each text's byte-level BPE ids as little-endian 16-bit integers, by the ranks in the file `path` (65,536 at most).

    A null text counts as empty and has no ids; a null doc_id is kept; repeated
    rows are encoded each; other columns are ignored, whatever their names; an
    empty table gives an empty result.
    """

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode = _byte_pairs(path).encode_ordinary
        ids = [np.array(encode(t), "<u2").tobytes() if t else b"" for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(in_slices(work), "doc_id long, ids binary")


def _matrices(size: int, pad: int, width: int):
    """Rows of the packed table from pieces that are sorted by row; a row's pieces may come in several batches."""

    def table(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        row, length = t.column("row").to_numpy(), t.column("length").to_numpy().astype(np.int64)
        new = np.concatenate([[True], row[1:] != row[:-1]])
        first, which = np.flatnonzero(new), np.cumsum(new) - 1
        before = np.cumsum(length) - length
        start = before - before[first][which]  # of each piece in its row
        blob = t.column("ids").chunk(0)
        ids = np.frombuffer(blob.buffers()[2], f"<u{width}")[np.frombuffer(blob.buffers()[1], np.int32)[blob.offset] // width :][: length.sum()]
        within = np.arange(len(ids)) - np.repeat(before, length)
        at = np.repeat(which * size + start, length) + within
        matrix, position = np.full(len(first) * size, pad, "<u4"), np.zeros(len(first) * size, "<u4")
        matrix[at], position[at] = ids, within
        ends = np.append(first, len(row))
        full = np.add.reduceat(length, first)
        # Each row's starts of pieces and, at the end, its number of ids.
        sums = np.insert(start, ends[1:], full).astype(np.int32)
        offsets = ends.astype(np.int32)
        bytes_at = pa.py_buffer(np.arange(0, len(first) + 1, dtype=np.int32) * np.int32(4 * size))
        fixed = [pa.Array.from_buffers(pa.binary(), len(first), [None, bytes_at, pa.py_buffer(x)]) for x in (matrix, position)]
        ids_of, parts = (pa.ListArray.from_arrays(pa.array(offsets), t.column(c).combine_chunks()) for c in ("doc_id", "part"))
        starts = pa.ListArray.from_arrays(pa.array(offsets + np.arange(len(offsets), dtype=np.int32)), pa.array(sums))
        return pa.RecordBatch.from_arrays(
            [pa.array(row[first]), ids_of, parts, starts, *fixed, pa.array(full.astype(np.int32))], ["row", "doc_ids", "parts", "cu_seqlens", "input_ids", "position_ids", "n_tokens"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in (whole.slice(i, PIECES) for whole in batches for i in range(0, whole.num_rows, PIECES)):
            row = batch.column("row").to_numpy()
            cut = int(np.searchsorted(row, row[-1]))  # the last row may go on in the next batch
            if held and cut:
                yield table([*held, batch.slice(0, cut)])
                held = []
            elif held and row[-1] != held[-1].column("row")[0].as_py():
                yield table(held)
                held = []
            elif cut:
                yield table([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield table(held)

    return run


def pack(encoded: DataFrame, size: int = ROW, pad: int = 0, width: int = 2, table: Scratch | None = None) -> DataFrame:
    """Rows (row, doc_ids, parts, cu_seqlens, input_ids, position_ids, n_tokens) from (doc_id, ids).

    `ids` are an array of integers or their little-endian bytes, `width` bytes
    each (2 hold ids up to 65,535; a larger id is an error). input_ids and
    position_ids are matrix rows of `size` little-endian 32-bit integers,
    filled up with `pad` and 0. Piece i of a row is input_ids[cu_seqlens[i] :
    cu_seqlens[i + 1]], part parts[i] of document doc_ids[i]; positions begin
    anew with each piece. Null or empty ids give no piece; a null doc_id is
    kept; repeated rows are packed each; other columns are ignored; an empty
    table gives an empty result. Pieces are numbered in the order of a hash of
    their content, so the order of the input does not matter. The number of
    partitions of shuffles does, as it decides which of two pieces of equal length comes first.
    The packed rows are written to the shared folder; if the tables of a job
    are given as `table`, they are made when they are read, before that job ends.
    """
    if table is None:
        with Scratch(encoded.sparkSession) as own:
            return materialize(pack(encoded, size, pad, width, own), "packed")
    spark = encoded.sparkSession
    if dict(encoded.dtypes)["ids"] != "binary":

        def flat(batches):
            for b in batches:
                ids = [None if x is None else np.array(x, np.int64) for x in b.column("ids").to_pylist()]
                if any(x is not None and len(x) and (x.min() < 0 or x.max() >= 1 << 8 * width) for x in ids):
                    raise ValueError(f"an id does not fit in {width} bytes")
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x is None else x.astype(f"<u{width}").tobytes() for x in ids], pa.binary())], ["doc_id", "ids"])

        encoded = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(flat, "doc_id long, ids binary")
    whole = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").where(F.length("ids") > 0)
    count = F.floor(F.length("ids") / width)
    cut = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / size).cast("int")), lambda p: F.struct(p.alias("part"), F.substring("ids", p * (size * width) + 1, F.lit(size * width)).alias("ids")))
    pieces = whole.select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.part", (F.length("x.ids") / width).cast("int").alias("length"), "x.ids", F.xxhash64("doc_id", "x.part", "x.ids").alias("h"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parts, "h").sortWithinPartitions("length", "h", "doc_id", "part")
    dealt = table(dealt.select("doc_id", "part", "length", "ids", F.monotonically_increasing_id().alias("at")), "pieces")
    # Within a partition, numbers of a length follow each other.
    starts = table(dealt.groupBy(F.shiftright("at", 33).cast("int").alias("p"), "length").agg(F.count("*").alias("n"), F.min("at").alias("first")), "starts")
    runs = best_fit_runs({r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    starts = table(starts.select("p", "length", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")), "shifts")
    runs = F.broadcast(spark.createDataFrame(runs, "length int, begin long, n long, start long, per long"))
    shifts = F.broadcast(starts) if starts.limit(BROADCAST_STARTS + 1).count() <= BROADCAST_STARTS else starts
    number = F.col("at") + F.col("shift")
    placed = dealt.withColumn("p", F.shiftright("at", 33).cast("int")).join(shifts, ["p", "length"]).withColumn("number", number).join(runs, "length")
    placed = placed.where(F.col("number").between(F.col("begin"), F.col("begin") + F.col("n") - 1)).withColumn("row", F.col("start") + F.floor((F.col("number") - F.col("begin")) / F.col("per")))
    placed = placed.select("row", "doc_id", "part", "length", "ids", "number").repartition(parts, "row").sortWithinPartitions("row", F.desc("length"), "number").drop("number")
    packed = placed.mapInArrow(_matrices(size, pad, width), "row long, doc_ids array<long>, parts array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary, n_tokens int")
    return packed


def pack_digests(packed: DataFrame) -> DataFrame:
    """Packed rows with SHA-256 digests of the matrix rows in their place: ids_sha256 of input_ids, positions_sha256 of position_ids.

    Null matrix rows have null digests; an empty table gives an empty result.
    """
    return packed.select("row", "doc_ids", "parts", "cu_seqlens", "n_tokens", F.sha2("input_ids", 256).alias("ids_sha256"), F.sha2("position_ids", 256).alias("positions_sha256"))
