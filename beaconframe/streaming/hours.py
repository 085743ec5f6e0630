"""I04 as a stream: hours are closed by the watermark, then handled in order with a ledger and a queue that survive restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from beaconframe.operators.hours import LEDGER, WAITING, hourly_runs, touched
from beaconframe.sources.snapshots import SnapshotStore


def closed_hours(events: DataFrame, late: str = "1 hour", ts: str = "ts", order: str = "n") -> DataFrame:
    """(hour, fingerprint, k, first) of each hour, once, when the watermark has passed its end; the state holds open hours only."""
    counts = events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), "fingerprint").agg(F.count("*").alias("k"), F.min(F.col(order).cast("long")).alias("first"))
    return counts.select(F.floor(F.unix_timestamp("w.start") / 3600).alias("hour"), "fingerprint", "k", "first")


def stream_hours(events: DataFrame, store: SnapshotStore, checkpoint: str, most: int | None = None, ttl: int | None = None, late: str = "1 hour", keep: int = 3) -> StreamingQuery:
    """Keeps `runs` and `records` of `operators.hours` up to date in the store as hours close.

    The ledger of fingerprints (entries go `ttl` hours after they were last met)
    and the queue of deferred records are tables of the same version as the
    results, under the number of the batch that made them: a batch that is
    repeated after a failure finds its number and changes nothing. However the
    events are cut into files, hours close in order and give the same runs, as
    long as no event comes later than `late`.
    """

    def merge(batch: DataFrame, number: int) -> None:
        note = store.note()
        if note.get("batch", -1) >= number:
            return
        hourly = batch.select("hour", "fingerprint", "k", "first").persist()
        try:
            last = hourly.agg(F.max("hour")).first()[0]
            if last is None:
                return
            ledger, waiting = store.read("ledger", LEDGER), store.read("waiting", WAITING)
            since = note["done"] + 1 if "done" in note else None
            runs, records, left = hourly_runs(hourly, most, ttl, ledger, waiting, since, last)
            store.write({"runs": runs, "records": records, "waiting": left, "ledger": touched(hourly, ttl, ledger, last)}, {"batch": number, "done": last}, append=("runs", "records"))
            store.vacuum(keep)
        finally:
            hourly.unpersist()

    return closed_hours(events, late).writeStream.outputMode("append").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


