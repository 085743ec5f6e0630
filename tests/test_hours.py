"""Hours with slots: the queue against a plain loop, streams against the batch, and what the store gives after broken writes."""

import random
from collections import deque
from datetime import datetime, timedelta

import pytest

from beaconframe.operators import hours
from beaconframe.sources.snapshots import SnapshotStore, read_json_events
from beaconframe.streaming.hours import stream_hours

EVENT = "n long, fingerprint string, ts timestamp"


def _events(seed, n=400):
    r = random.Random(seed)
    start = datetime(2026, 6, 17)
    times = sorted(start + timedelta(minutes=r.choice([r.randrange(60 * 8), r.randrange(60 * 40)])) for _ in range(n))
    return [(i, f"f{int(r.random() ** 2 * 120)}", t) for i, t in enumerate(times)]


def _hour(t):
    return int((t - datetime(1970, 1, 1)).total_seconds() // 3600)


def _plain(events, most, ttl, until=None):
    """One hour after the other with a ledger and a queue."""
    by, runs, records, queue, last = {}, [], [], deque(), {}
    for n, f, t in events:
        by.setdefault(_hour(t), []).append((n, f))
    h = min(by)
    while (h <= max(by) or queue) and (until is None or h <= until):
        rows = by.get(h, [])
        came = sorted((min(n for n, f in rows if f == x), x) for x in {f for _, f in rows} if x not in last or (ttl is not None and h - last[x] > ttl))
        queue.extend(came)
        taken = [queue.popleft() for _ in range(min(len(queue), len(queue) if most is None else most))]
        records += [(h, f, n) for n, f in taken]
        last |= {f: h for _, f in rows}
        if rows or taken or queue:
            runs.append((h, len(rows), len({f for _, f in rows}), len(came), len(taken), len(rows) - len(came), len(queue)))
        h += 1
    return runs, sorted(records)


@pytest.mark.parametrize("seed,most,ttl", [(1, None, None), (2, 5, None), (3, 3, 6), (4, None, 2)])
def test_all_hours_at_once_equal_one_after_the_other(spark, seed, most, ttl):
    rows = _events(seed)
    runs, records, left = hours.hourly_runs(hours.by_hour(spark.createDataFrame(rows, EVENT)), most, ttl)
    want = _plain(rows, most, ttl)
    assert sorted(map(tuple, runs.collect())) == want[0] and sorted(map(tuple, records.collect())) == want[1] and left.count() == 0


def test_no_events(spark):
    assert [x.count() for x in hours.hourly_runs(hours.by_hour(spark.createDataFrame([], EVENT)), 3, 4)] == [0, 0, 0]


@pytest.mark.parametrize("files", [1, 4])
def test_a_stream_in_any_number_of_files_gives_the_batch_and_survives_a_restart(spark, tmp_path, files):
    rows = _events(7, 300)
    end = (10_000, "end", rows[-1][2] + timedelta(hours=9))  # closes all hours before it
    store, source = SnapshotStore(spark, str(tmp_path / "store")), str(tmp_path / "in")
    cuts = [round(i * len(rows) / files) for i in range(files + 1)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame(rows[a:b] + [end] * (i == files - 1), EVENT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
        stream_hours(stream, store, str(tmp_path / "checkpoint"), most=4, ttl=5, late="0 seconds").awaitTermination()  # another start for each file
    done = store.note()["done"]
    want = _plain(rows, 4, 5, until=done)
    assert done >= _hour(rows[-1][2])
    assert sorted(map(tuple, store.read("runs", hours.RUNS).collect())) == want[0]
    assert sorted(map(tuple, store.read("records", hours.RECORDS).collect())) == want[1]
    assert len(store.versions()) <= 3


def test_a_torn_write_a_missing_and_a_corrupt_file(spark, tmp_path):
    root = tmp_path / "events"
    store = SnapshotStore(spark, str(root))
    frame = lambda *rows: spark.createDataFrame(rows, "n long, day date")
    read = lambda: sorted(r["n"] for r in store.read("events", "n long, day date").collect())
    d = datetime(2026, 6, 1).date()
    assert read() == [] and store.note() == {} and store.versions() == []
    store.write({"events": frame((1, d), (2, d + timedelta(1)))}, {"who": "a"}, {"events": "day"})
    store.write({"events": frame((3, d + timedelta(1)))}, {"who": "b"}, {"events": "day"})
    assert read() == [1, 3] and store.note() == {"who": "b"}
    (root / "manifests" / "000000000003.json").write_text('{"version": 3, "tables": {"ev')  # torn
    assert read() == [1, 3]
    assert store.write({"other": frame((9, d))}) == 4 and read() == [1, 3]
    newest = next(p for p in root.glob("data/*/_day=2026-06-02/*.parquet") if p.stat().st_mtime == max(q.stat().st_mtime for q in root.glob("data/*/_day=2026-06-02/*.parquet")))
    newest.write_bytes(newest.read_bytes()[:-7])  # cut short: versions 2 and 4 name it
    assert read() == [1, 2] and store.note() == {"who": "a"}
    newest.unlink()
    assert read() == [1, 2]
    store.vacuum(1)
    assert read() == [1, 2]


def test_json_events_missing_or_broken_are_empty(spark, tmp_path):
    path, kind = str(tmp_path / "e.json"), "id string, n long"
    assert read_json_events(spark, path, kind).collect() == []
    (tmp_path / "e.json").write_text('[{"id": "a", "n": 1, "more": {}}, {"id": null}]')
    assert sorted(map(tuple, read_json_events(spark, path, kind).collect()), key=str) == [("a", 1), (None, None)]
    for text in ('[{"id": "a", "n": 1}, {"id"', "", "no json"):
        (tmp_path / "e.json").write_text(text)
        assert read_json_events(spark, path, kind).collect() == []


def test_days_of_one_run_add_up_and_another_run_is_merged_by_the_larger_count(spark, tmp_path):
    from beaconframe.streaming.rolling import CELLS, roll_daily

    kind = "n long, ts timestamp, scope string, risk string, category string"
    store, source = SnapshotStore(spark, str(tmp_path / "store")), str(tmp_path / "in")
    day = datetime(2026, 6, 17)

    def run(counts, name):
        for k in counts:
            spark.createDataFrame([(i, day, "domestic", "low", "a") for i in range(k)], kind).coalesce(1).write.mode("append").parquet(source)
            roll_daily(spark.readStream.schema(kind).parquet(source), store, str(tmp_path / "checkpoint"), name).awaitTermination()
        return {r["dim"]: r["n"] for r in store.read("cells", CELLS).collect()}

    assert run([2, 3], "one") == dict.fromkeys(("total", "scope", "risk", "category"), 5)
    assert run([4], "two") == dict.fromkeys(("total", "scope", "risk", "category"), 5)
    assert run([4], "two") == dict.fromkeys(("total", "scope", "risk", "category"), 8)
