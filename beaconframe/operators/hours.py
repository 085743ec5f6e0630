"""I04 over many hours: which new records each hour takes when it has a bounded number of slots.

An event is an arrival if its fingerprint was not met before, or not within
`ttl` hours; all others are duplicates. Arrivals queue in the order of their
hour and number, each hour takes `most` of them, and what is left comes back in
the next. With A(h) arrivals up to hour h, D(h) = most * h + min over j <= h of
A(j) - most * j records are taken up to it, so the hour of an arrival follows from
its place in the queue, and no hour has to wait for another one's result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconframe.operators.ranking import ranked
from beaconframe.operators.state import materialize

HOURLY = "hour long, fingerprint string, k long, first long"
RUNS = "hour long, fetched long, unique long, arrived long, new long, duplicate long, deferred long"
RECORDS, WAITING, LEDGER = "hour long, fingerprint string, first long", "came long, fingerprint string, first long", "hour long, fingerprint string"


def by_hour(events: DataFrame, ts: str = "ts", order: str = "n") -> DataFrame:
    """(hour, fingerprint, k, first): how often each fingerprint occurs in each hour (hours since 1970), and its first number there."""
    hour = F.floor(F.unix_timestamp(ts) / 3600).alias("hour")
    return events.groupBy(hour, "fingerprint").agg(F.count("*").alias("k"), F.min(F.col(order).cast("long")).alias("first"))


def arrivals(hourly: DataFrame, ttl: int | None = None, ledger: DataFrame | None = None) -> DataFrame:
    """The rows whose fingerprint has no earlier row, in `hourly` or in `ledger` (hour, fingerprint), or none within `ttl` hours before."""
    rows = hourly.select("hour", "fingerprint", "k", "first")
    if ledger is not None:
        rows = rows.unionByName(ledger.select("hour", "fingerprint", F.lit(0).cast("long").alias("k"), F.lit(None).cast("long").alias("first")))
    last = F.lag("hour").over(Window.partitionBy("fingerprint").orderBy("hour"))
    fresh = last.isNull() if ttl is None else last.isNull() | (F.col("hour") - last > ttl)
    return rows.withColumn("_fresh", fresh).where("_fresh and k > 0").drop("_fresh")


def touched(hourly: DataFrame, ttl: int | None = None, ledger: DataFrame | None = None, until: int | None = None) -> DataFrame:
    """The ledger (hour, fingerprint) after `hourly`: the last hour of each fingerprint, without those that are older than `ttl` hours at `until`."""
    rows = hourly.select("hour", "fingerprint")
    rows = (rows if ledger is None else rows.unionByName(ledger.select("hour", "fingerprint"))).groupBy("fingerprint").agg(F.max("hour").alias("hour")).select("hour", "fingerprint")
    return rows if ttl is None or until is None else rows.where(F.col("hour") >= until - ttl)


def hourly_runs(
    hourly: DataFrame, most: int | None = None, ttl: int | None = None, ledger: DataFrame | None = None, waiting: DataFrame | None = None, since: int | None = None, until: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, records, waiting) of the hours from `since` to `until`; without those from the first to the one in which the queue is empty.

    runs: for each hour the events fetched, their distinct fingerprints, arrivals,
    new records taken, duplicates, and records deferred to the next hour.
    records: (hour in which it is taken, fingerprint, first number) of each new record.
    waiting: (came, fingerprint, first) of what is left; as an argument, what an earlier call has left.
    """
    spark = hourly.sparkSession
    queue = arrivals(hourly, ttl, ledger).select(F.col("hour").alias("came"), "fingerprint", "first")
    told = hourly.groupBy("hour").agg(F.sum("k").alias("fetched"), F.count("*").alias("unique"))
    counts = materialize(told.join(queue.groupBy(F.col("came").alias("hour")).agg(F.count("*").alias("arrived")), "hour", "left").na.fill(0), "hours")
    low, high, n = counts.agg(F.min("hour"), F.max("hour"), F.coalesce(F.sum("arrived"), F.lit(0))).first()
    held = waiting.count() if waiting is not None else 0
    since, none = low if since is None else since, spark.createDataFrame([], WAITING)
    if since is None or (low is None and not held):
        return spark.createDataFrame([], RUNS), spark.createDataFrame([], RECORDS), none
    queue = queue if waiting is None else queue.unionByName(waiting.select("came", "fingerprint", "first"))
    if until is None:
        until = max(since, since if high is None else high) + (-(-(n + held) // most) if most is not None else 0)
    # One row for each hour; what was held over counts from the first on.
    hours, w = spark.range(since, until + 1).select(F.col("id").alias("hour")).join(counts, "hour", "left").na.fill(0), Window.orderBy("hour")
    hours = hours.withColumn("a", F.sum("arrived").over(w.rowsBetween(Window.unboundedPreceding, 0)) + held)
    if most is None:
        hours = hours.withColumn("d", F.col("a"))
    else:
        slack = F.lag("a", 1, 0).over(w) - F.lit(most) * (F.col("hour") - since)
        hours = hours.withColumn("_slack", slack).withColumn("d", F.least("a", F.lit(most) * (F.col("hour") - since + 1) + F.min("_slack").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    hours = materialize(hours.withColumn("new", F.col("d") - F.lag("d", 1, 0).over(w)), "hours")
    runs = hours.where("fetched > 0 or new > 0 or a > d").select("hour", "fetched", "unique", "arrived", "new", (F.col("fetched") - F.col("arrived")).alias("duplicate"), (F.col("a") - F.col("d")).alias("deferred"))
    if most is None:
        return runs, queue.select(F.col("came").alias("hour"), "fingerprint", "first"), none
    placed = ranked(queue, [], [F.asc("came"), F.asc("first"), F.asc("fingerprint")], "place")
    # An hour takes `most` places at most, so it meets two stretches of that many.
    stretch = lambda x: F.floor((x - 1) / most)
    spans = hours.where("new > 0").select("hour", (F.col("d") - F.col("new")).alias("after"), "d")
    spans = spans.withColumn("_b", F.explode(F.array_distinct(F.array(stretch(F.col("after") + 1), stretch(F.col("d"))))))
    taken = placed.withColumn("_b", stretch(F.col("place"))).join(spans, "_b").where("place > after and place <= d").select("hour", "fingerprint", "first")
    total = hours.agg(F.max("d")).first()[0]
    return runs, taken, placed.where(F.col("place") > total).select("came", "fingerprint", "first")
