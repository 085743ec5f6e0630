"""Structured Streaming forms of the state across runs: fresh events once, hourly counts, daily cells.

State is bounded by watermarks. Batches merge into tables of the caller, so a
batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from beaconframe.operators.rollups import daily_cells, max_merge
from beaconframe.sources.snapshots import SnapshotStore

CELLS = "day string, dim string, value string, n long"


def fresh_once(events: DataFrame, key: str = "id", ts: str = "ts", late: str = "5 days") -> DataFrame:
    """The first event of each key among those that are `late` apart at most; later repeats are dropped."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def hourly_counts(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """(hour, category, n): events of each hour and category; an hour is complete once the watermark has passed it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), "category").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "category", "n")


def roll_daily(events: DataFrame, store: SnapshotStore, checkpoint: str, run: str = "") -> StreamingQuery:
    """Keep a table of daily cells up to date, `cells` in the store.

    Batches of one run add up, since each event comes once: a day's count is
    that of all its batches. Another `run`, which fetches the same days again,
    begins anew and is merged with what there was before it by the larger count.
    The numbers of batches are kept in the same version, so a repeated one
    changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        note = store.note()
        if note.get("batch", -1) >= number:
            return
        same = note.get("run") == run
        before = store.read("before" if same else "cells", CELLS)
        sums = daily_cells(batch)
        if same:
            sums = sums.unionByName(store.read("run", CELLS)).groupBy("day", "dim", "value").agg(F.sum("n").alias("n"))
        store.write({"run": sums, "before": before, "cells": max_merge(before, sums)}, {"batch": number, "run": run})
        store.vacuum(3)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
