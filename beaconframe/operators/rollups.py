"""Daily cells, coverage matrices, key figures and freshness buckets."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SCOPES, RISKS = ("domestic", "international"), ("low", "medium", "high", "critical")


def daily_cells(df: DataFrame) -> DataFrame:
    """(day, dim, value, n): events by day in total and by scope, risk and category, from one scan and one shuffle.

    A scope or risk that is none of the known ones counts in the total only; a blank category is 'uncategorised'.
    """
    cell = lambda dim, value: F.struct(F.lit(dim).alias("dim"), value.alias("value"))
    cells = [cell("total", F.lit("all")), cell("category", F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("uncategorised")))]
    cells += [F.when(F.col(c).isin(*known), cell(c, F.col(c))) for c, known in (("scope", SCOPES), ("risk", RISKS))]
    by = df.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "scope", "risk", "category").agg(F.count("*").alias("n"))
    return by.select("day", F.explode(F.array_compact(F.array(*cells))).alias("c"), "n").groupBy("day", "c.dim", "c.value").agg(F.sum("n").alias("n"))


def max_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Daily cells of two runs with the larger count each, so a run that is repeated changes nothing."""
    return old.unionByName(new).groupBy("day", "dim", "value").agg(F.max("n").alias("n"))


def coverage_matrix(df: DataFrame) -> DataFrame:
    """Events, elevated ones (high or critical), sources and regions by scope and category, with totals (null category)."""
    return df.rollup("scope", "category").agg(
        F.count("*").alias("events"), F.count_if(F.col("risk_rank") >= 3).alias("elevated"), F.count_distinct("source_name").alias("sources"), F.count_distinct("region").alias("regions")
    ).where("scope is not null")


def full_coverage(df: DataFrame, sources: DataFrame, kind: Column) -> DataFrame:
    """By scope and category, with totals (null category), events, elevated, located, official and news ones (by `kind`), and source rows, healthy, contributing and official sources."""
    located = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    e = df.withColumn("_kind", kind).rollup("scope", "category").agg(
        F.count("*").alias("events"), F.count_if(F.col("risk_rank") >= 3).alias("elevated"), F.count_if(located).alias("located"), F.count_if(F.col("_kind") == "official").alias("official"), F.count_if(F.col("_kind") == "news").alias("news")
    )
    healthy = F.col("configured") & ~F.coalesce(F.col("stale"), F.lit(False))
    s = sources.rollup("scope", "category").agg(F.count("*").alias("source_rows"), F.count_if(healthy).alias("healthy"), F.count_if(F.col("events") > 0).alias("contributing"), F.count_if(F.col("authority") == "official").alias("official_sources"))
    null_safe = [F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("scope", "category")]
    both = e.where("scope is not null").alias("e").join(s.where("scope is not null").alias("s"), null_safe[0] & null_safe[1], "full")
    counts = ("events", "elevated", "located", "official", "news", "source_rows", "healthy", "contributing", "official_sources")
    return both.select(*(F.coalesce(f"e.{c}", f"s.{c}").alias(c) for c in ("scope", "category")), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


def full_grid(df: DataFrame, end: datetime, kind: Column, fresh: Column, days: int = 7, kinds: tuple[str, ...] = ("official", "news")) -> DataFrame:
    """(region, category, kind, day, n, fresh, stale) over `days` local days with the empty cells. The grid is as large as the product of the small vocabularies of regions, categories and kinds."""
    local = F.date_format(F.col("ts") + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd")
    axis = [(end + timedelta(hours=8) - timedelta(days=i)).strftime("%Y-%m-%d") for i in range(days)]
    named = df.withColumn("kind", kind).withColumn("day", local).withColumn("_fresh", fresh == "fresh")
    frame = df.select("region").distinct().join(df.select("category").distinct()).withColumn("kind", F.explode(F.array(*map(F.lit, kinds)))).withColumn("day", F.explode(F.array(*map(F.lit, axis))))
    counts = named.where(F.col("day").isin(*axis) & F.col("kind").isin(*kinds)).groupBy("region", "category", "kind", "day").agg(F.count("*").alias("n"), F.count_if("_fresh").alias("fresh"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return frame.join(counts, ["region", "category", "kind", "day"], "left").select("region", "category", "kind", "day", zero("n").alias("n"), zero("fresh").alias("fresh"), (zero("n") - zero("fresh")).alias("stale"))


def blind_spots(grid: DataFrame) -> DataFrame:
    """(region, category, kind, spot): cells of the grid's days together that have no event at all, or stale ones only."""
    s = grid.groupBy("region", "category", "kind").agg(F.sum("n").alias("n"), F.sum("fresh").alias("fresh"))
    return s.select("region", "category", "kind", F.when(F.col("n") == 0, "blind").when(F.col("fresh") == 0, "stale only").alias("spot")).where("spot is not null")


def coverage_grid(df: DataFrame, end: datetime, days: int = 7) -> DataFrame:
    """(region, category, day, n) over the last `days` days with the empty cells; the grid is as large as the product of the two vocabularies."""
    frame = df.select("region").distinct().join(df.select("category").distinct())
    grid = frame.withColumn("day", F.explode(F.array(*[F.lit((end - timedelta(days=i)).strftime("%Y-%m-%d")) for i in range(days)])))
    counts = df.where(F.col("ts").between(F.lit(end - timedelta(days=days)), F.lit(end + timedelta(days=1)))).groupBy("region", "category", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["region", "category", "day"], "left").select("region", "category", "day", F.coalesce("n", F.lit(0)).alias("n"))


def kpi(df: DataFrame, now: datetime) -> DataFrame:
    """Events of the last 24 hours and of the 24 before, their difference, and the elevated share in percent."""
    day = timedelta(days=1)
    last, before = F.col("ts").between(F.lit(now - day), F.lit(now)), (F.col("ts") >= F.lit(now - 2 * day)) & (F.col("ts") < F.lit(now - day))
    a = df.agg(F.count_if(last).alias("last"), F.count_if(before).alias("previous"), F.count_if(last & (F.col("risk_rank") >= 3)).alias("elevated"))
    return a.select("last", "previous", (F.col("last") - F.col("previous")).alias("delta"), "elevated", F.when(F.col("last") > 0, F.floor(100 * F.col("elevated") / F.col("last") + 0.5)).otherwise(0).alias("elevated_pct"))


def freshness(df: DataFrame, generated: datetime, max_hours: float) -> DataFrame:
    """Each dataset's last event, its age in whole hours and whether it is stale."""
    age = F.floor((F.unix_timestamp(F.lit(generated)) - F.unix_timestamp("last")) / 3600)
    return df.groupBy("dataset").agg(F.max("ts").alias("last")).select("dataset", age.alias("age_hours"), F.when(age > max_hours, "stale").otherwise("fresh").alias("bucket"))


def merge_rollup(old: DataFrame, new: DataFrame, days: int = 90) -> DataFrame:
    """`max_merge` of two runs' daily cells, kept for `days` days up to the newest day of `new` (of `old` if `new` has none); 0 or less keeps all.

    Cells without a day are left out.
    """
    merged = max_merge(old, new).where("day is not null")
    if days <= 0:
        return merged
    last = new.agg(F.max("day").alias("new_last")).join(old.agg(F.max("day").alias("old_last")))
    anchor = last.select(F.date_format(F.date_sub(F.to_date(F.coalesce("new_last", "old_last")), days - 1), "yyyy-MM-dd").alias("first_day"))
    return merged.join(F.broadcast(anchor), F.col("day") >= F.col("first_day")).select("day", "dim", "value", "n")


def calibrate_minimum(runs: DataFrame, now: datetime, days: int = 7, percent: int = 25, fallback: int = 200) -> DataFrame:
    """(minimum, sample_size): the percentile of new records an hour over the successful runs of the last `days` days, or `fallback` without any.

    `runs` has generated_at, hour (the local hour of the run as text), n (new
    records) and has_news. A run counts if it is not later than `now`, not of the hour of
    the run at `now` in UTC+8, found something and holds a news record. The order
    statistic is that of index floor((size - 1) * percent / 100).
    """
    hour = (now + timedelta(hours=8)).strftime("%Y-%m-%d %H:00")
    good = runs.where(F.col("generated_at").between(F.lit(now - timedelta(days=days)), F.lit(now)) & ~F.col("hour").eqNullSafe(hour) & (F.col("n") > 0) & F.col("has_news"))
    by_n = good.groupBy(F.col("n").cast("long").alias("n")).agg(F.count("*").alias("c"))  # as many rows as there are distinct counts
    upto = by_n.select("n", F.sum("c").over(Window.orderBy("n")).alias("upto"))
    size = by_n.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("sample_size"))
    at = F.floor((F.col("sample_size") - 1) * percent / 100)
    found = size.join(upto, F.col("upto") > at, "left").groupBy("sample_size").agg(F.min("n").alias("m"))
    return found.select(F.coalesce("m", F.lit(max(1, fallback)).cast("long")).alias("minimum"), "sample_size")
