"""Searches by postings and viewports by files, against scans."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beaconframe.operators import filters, graph, search, zorder
from beaconframe.operators.search import BUCKETS, PostingIndex


def test_postings_give_the_rows_of_a_scan_and_read_the_query_s_folders_only(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("abAB é中") for _ in range(r.randint(0, 12))), r.choice([None, "", "xyz", "ab中"])) for i in range(600)] + [(None, "abab", "")]
    df = spark.createDataFrame(rows, "n long, t string, u string")
    index = PostingIndex(spark, str(tmp_path), "n", ["t", "u"])
    assert index.search(df.limit(0), "aba").count() == 0
    index.update(df.where("n < 200"))
    index.update(df)
    index.update(df)
    assert index.keys().count() == 600
    entered = df.where("n is not null")
    for query in ("abab", "ba b", "AB中", "é", "", "  ", "zzz", "yzx", "bxy", "ab中", "aaaaaaaaaaaaaa"):
        got, want = index.search(entered, query), graph.text_search(entered, query, ["t", "u"])
        assert sorted(x["n"] for x in got.collect()) == sorted(x["n"] for x in want.collect()), query
    files = {f.rsplit("bucket=")[-1].split("/")[0] for f in index.candidates("xyz").inputFiles()}
    plan = index.candidates("xyz")._jdf.queryExecution().toString()
    assert len(files) <= BUCKETS and "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1][:80]


@pytest.mark.parametrize("most", [1, 40, 1 << 21])
def test_f27_postings_of_a_chunk_are_one_row_for_each_gram(most, monkeypatch):
    monkeypatch.setattr(search, "CHUNK", most)
    r = random.Random(most)
    texts = ["", "ab", "abab", "\U0001f600a\U0001f600a\U0001f600", *("".join(r.choice("ab é中\x1f") for _ in range(r.randint(0, 30))) for _ in range(80))]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, min(i + 30, len(texts)))), pa.array(texts[i : i + 30])], ["key", "text"]) for i in range(0, len(texts), 30)]
    found = [(row["gram"], row["keys"]) for b in search._posted(iter(batches)) for row in b.to_pylist()]
    want = {(t[i : i + 3], k) for k, t in enumerate(texts) for i in range(len(t) - 2)}
    every = [(gram, k) for gram, keys in found for k in keys]
    assert sorted(every) == sorted(want)
    assert most < 1 << 21 or len(found) == len({gram for gram, _ in want}) < len(want) / 3


def test_a_viewport_opens_few_files_and_gives_the_rows_of_a_scan(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(3000)] + [(i, 25.0 + r.random() / 50, 121.5) for i in range(3000, 5000)] + [(5000, None, 1.0), (5001, 91.0, 0.0), (5002, 90.0, 180.0), (5003, -90.0, -180.0)]
    df = spark.createDataFrame(rows, "n long, lat double, lng double")
    path = str(tmp_path / "z")
    zorder.write_clustered(df, path, 40)
    placed = df.where(zorder.z_key(F.col("lat"), F.col("lng")).isNotNull())
    total = spark.read.parquet(f"{path}/bounds").count()
    for box in ((24, 121, 26, 122), (-90, -180, 90, 180), (10, 10, 10.1, 10.1), (25.0, 121.5, 25.01, 121.5), (50, -100, 60, -90), (89, 179, 95, 190)):
        got = zorder.read_viewport(spark, path, *box)
        want = placed.where(filters.in_viewport(F.col("lat"), F.col("lng"), *box))
        assert sorted(x["n"] for x in got.collect()) == sorted(x["n"] for x in want.collect()), box
        assert set(got.columns) == set(df.columns)
    assert total == 40 and len(zorder.files_of(spark, path, 50, -100, 60, -90)) <= 8 and len(zorder.files_of(spark, path, 10, 10, 10.1, 10.1)) <= 2


@pytest.mark.parametrize("seed", range(5))
def test_ranges_cover_the_viewport(seed):
    r = random.Random(seed)
    south, west = r.uniform(-90, 89), r.uniform(-180, 179)
    north, east = south + r.uniform(0, 90 - south), west + r.uniform(0, 180 - west)
    ranges = zorder.key_ranges(south, west, north, east)
    assert 0 < len(ranges) <= zorder.RANGES and all(a <= b for a, b in ranges) and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:], strict=False))
    for _ in range(200):
        y, x = zorder._cell(r.uniform(south, north), -90.0, 180.0), zorder._cell(r.uniform(west, east), -180.0, 360.0)
        key = sum((y >> i & 1) << 2 * i + 1 | (x >> i & 1) << 2 * i for i in range(zorder.BITS))
        assert any(a <= key <= b for a, b in ranges)
