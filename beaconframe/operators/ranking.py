"""Places of rows within large groups, without a group in one task.

Rows are dealt in ranges of (group, order), sorted and numbered where they lie,
and written. How many rows of a group each range holds is a small table; its
running sums turn those numbers into places. A group of any size is spread over
as many tasks as its share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconframe.operators.state import Scratch, materialize

#: Rows of the table of ranges up to which it is broadcast.
BROADCAST_RANGES = 500_000


def ranked(df: DataFrame, by: list[str], order: list[Column], rank: str = "rank", count: str | None = None, table: Scratch | None = None) -> DataFrame:
    """`df` with the place of each row in its group from 1, and the group's rows as `count` if that is named.

    Equal to row_number() over the group, for any order; rows that the order
    does not tell apart come as they lie. Null keys make a group. The numbered
    rows are written, among the tables of the job `table` if that is given.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*by).alias("_by") if by else F.struct(F.lit(0)).alias("_by")
    dealt = df.withColumn("_by", key).repartitionByRange(parts, F.col("_by"), *order).sortWithinPartitions(F.col("_by"), *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = (table or materialize)(dealt, "ranked").withColumn("_p", F.shiftright("_at", 33).cast("int"))
    ranges = dealt.groupBy("_p", "_by").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy("_by")
    before = F.coalesce(F.sum("_n").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("_p", "_by", (before - F.col("_first") + 1).alias("_shift"), *([F.sum("_n").over(w).alias(count)] if count else []))
    ranges = (table or materialize)(ranges, "ranges")
    small = ranges.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    return dealt.join(F.broadcast(ranges) if small else ranges, ["_p", "_by"]).withColumn(rank, F.col("_at") + F.col("_shift")).drop("_by", "_p", "_at", "_shift")
