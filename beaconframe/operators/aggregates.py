"""Aggregates of events, sources, feeds and runs: distributions, funnels, buckets, grids, registries."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconframe.operators.state import small

_DAY_US = 86_400_000_000


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100 * part / whole, 2)).otherwise(0.0)


def _age_us(now: datetime, ts: Column) -> Column:
    return F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))


def distribution(df: DataFrame, by: str) -> DataFrame:
    """Count and percentage of each value of `by`; the total is joined as one row."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    total = F.broadcast(df.agg(F.count("*").alias("_total")))
    return counts.join(total).select(by, "n", _pct(F.col("n"), F.col("_total")).alias("pct"))


def domain_coverage(domains: DataFrame, config: DataFrame, sources: DataFrame) -> DataFrame:
    """For each domain the configured and enabled entries of `config` (domain, enabled), and of its sources the observed and healthy ones and the last success.

    `domains` has key, scope, datasets and categories (arrays); a source is a
    domain's if the scope is equal and its dataset or category is listed. Both are small tables next to `sources`.
    """
    listed = config.groupBy(F.col("domain").alias("key")).agg(F.count("*").alias("configured"), F.count_if("enabled").alias("enabled"))
    s = sources.alias("s")
    of = domains.select("key", "scope", "datasets", "categories").alias("d")
    match = (F.col("d.scope") == F.col("s.scope")) & (F.array_contains("d.datasets", F.col("s.dataset")) | F.array_contains("d.categories", F.col("s.category")))
    seen = s.join(small(of), match).groupBy("d.key").agg(F.count("*").alias("observed"), F.count_if(~F.col("s.stale") & (F.col("s.events") > 0)).alias("healthy"), F.max("s.last_success").alias("last_success"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return domains.select("key").join(listed, "key", "left").join(seen, "key", "left").select("key", *map(zero, ("configured", "enabled", "observed", "healthy")), "last_success")


def source_funnel(stages: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """Rows of each feed in the stages raw, unique, relevant, before (retention) and final, with losses, rates, share and why a feed gives little.

    All stages are counted in one pass over their union.
    """
    every = None
    for name, df in stages.items():
        tagged = df.select(F.col(label).alias("label"), F.lit(name).alias("stage"))
        every = tagged if every is None else every.union(tagged)
    counts = every.groupBy("label").agg(*(F.count_if(F.col("stage") == s).alias(s) for s in ("raw", "unique", "relevant", "before", "final")))
    total = F.broadcast(counts.agg(F.sum("final").alias("_total")))
    c = counts.join(total).withColumn("before", F.when(F.col("before") > 0, F.col("before")).otherwise(F.col("final")))
    lost = lambda a, b: F.greatest(F.lit(0), F.col(a) - F.col(b))
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0)
    dropped = lost("before", "final")
    why = F.when((F.col("relevant") > 0) & (F.col("final") == 0) & (dropped > 0), "dropped_by_retention").when((F.col("raw") >= 3) & (F.col("final") == 0), "raw_without_final").when((F.col("raw") >= 10) & (F.col("final") <= 1), "low_final_events")
    return c.select(
        "label", "raw", "unique", "relevant", "final", lost("raw", "unique").alias("deduped"), lost("unique", "relevant").alias("irrelevant"), dropped.alias("dropped_by_retention"), lost("relevant", "final").alias("dropped_after"),
        rate("unique", "raw").alias("unique_rate"), rate("relevant", "unique").alias("relevance_rate"), rate("final", "_total").alias("final_share"), why.alias("reason"),
    )


def contribution_order() -> list[Column]:
    """Most final rows first, then relevant, unique, raw ones, then by label."""
    return [F.desc("final"), F.desc("relevant"), F.desc("unique"), F.desc("raw"), F.asc("label")]


def low_contribution(funnel: DataFrame, least_raw: int = 10, most_final: int = 1) -> DataFrame:
    """Feeds with `least_raw` raw rows or more of which `most_final` or fewer are left."""
    return funnel.where((F.col("raw") >= least_raw) & (F.col("final") <= most_final)).select("label", "raw", "final")


def source_tree(df: DataFrame, least: int | None = None) -> DataFrame:
    """(category, n, sources): each category's sources with their counts, most first, then by name; with `least`, whether the category reaches it."""
    leaf = df.groupBy("category", "source_name", "dataset").agg(F.count("*").alias("k"))
    tree = leaf.groupBy("category").agg(F.sum("k").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("order"), "source_name", "dataset"))).alias("s"))
    out = tree.select("category", "n", F.transform("s", lambda x: F.struct(x["source_name"].alias("source_name"), x["dataset"].alias("dataset"), (-x["order"]).alias("n"))).alias("sources"))
    return out if least is None else out.withColumn("enough", F.col("n") >= least)


def rolling_day_counts(df: DataFrame, now: datetime, days: int = 5) -> DataFrame:
    """(bucket, n) of the last `days` spans of 24 hours, 0 the oldest, with empty ones."""
    bucket = F.lit(days - 1) - F.floor(_age_us(now, F.col("ts")) / _DAY_US)
    counts = df.where(F.col("ts") <= F.lit(now)).groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(days).select(F.col("id").cast("int").alias("bucket"))
    return frame.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def calendar_day_counts(df: DataFrame, now: datetime, days: int = 5) -> DataFrame:
    """(day, n) of the last `days` calendar days, with empty ones."""
    frame = df.sparkSession.range(days).select(F.date_format(F.date_sub(F.to_date(F.lit(now)), F.col("id").cast("int")), "yyyy-MM-dd").alias("day"))
    counts = df.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return frame.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def source_kpi(sources: DataFrame, generated: datetime) -> DataFrame:
    """By scope the sources, those active (a success within 24 hours and not stale) and the share of official ones in percent."""
    active = ~F.col("stale") & (_age_us(generated, F.col("last_success")) <= _DAY_US)
    return sources.groupBy("scope").agg(F.count("*").alias("sources"), F.count_if(F.coalesce(active, F.lit(False))).alias("active"), F.count_if(F.col("authority") == "official").alias("official")).withColumn("official_pct", _pct(F.col("official"), F.col("sources")))


def aggregator_health(status: DataFrame, least: int = 5, floor: float = 0.5) -> DataFrame:
    """Of the aggregator's feeds (gn) the number, those ok, their rate, and whether the failure is systemic."""
    a = status.where("gn").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"))
    rate = F.when(F.col("n") > 0, F.round(F.col("ok") / F.col("n"), 4)).otherwise(1.0)
    return a.select("n", "ok", rate.alias("rate"), ((F.col("n") >= least) & (F.col("ok") < F.col("n") * floor)).alias("systemic"))


def feed_audit(status: DataFrame, least_feeds: int, least_items: int) -> DataFrame:
    """Feeds that are ok and their items, and whether both reach their minima."""
    a = status.agg(F.count_if("ok").alias("ok_feeds"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"))
    return a.withColumn("passed", (F.col("ok_feeds") >= least_feeds) & (F.col("items") >= least_items))


def post_fetch_metrics(df: DataFrame, feed: str = "source_name") -> DataFrame:
    """Events and distinct feeds of official and of all other events, in one row."""
    official = F.col("authority") == "official"
    return df.agg(
        F.count_if(official).alias("official_events"), F.count_distinct(F.when(official, F.col(feed))).alias("official_feeds"), F.count_if(~official).alias("general_events"), F.count_distinct(F.when(~official, F.col(feed))).alias("general_feeds")
    )


def source_counts(df: DataFrame) -> DataFrame:
    """Events of each source and category, with the smallest dataset and the first and last time."""
    return df.groupBy("source_name", "category").agg(F.count("*").alias("n"), F.min("dataset").alias("dataset"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def latest_fetched(df: DataFrame, fetched: str) -> DataFrame:
    """Each source's latest time of fetching; texts that are no times do not count."""
    return df.groupBy("source_name").agg(F.max(F.try_to_timestamp(F.col(fetched).cast("string"))).alias("latest")).where("latest is not null")


def channel_summary(sources: DataFrame, generated: datetime) -> DataFrame:
    """Official and media channels: sources, events, latest success and how fresh it is (ok within a day, warn within three, else bad)."""
    channel = F.when(F.col("authority") == "official", "official").otherwise("media")
    a = sources.groupBy(channel.alias("channel")).agg(F.count("*").alias("sources"), F.sum("events").alias("events"), F.max("last_success").alias("latest"))
    age = _age_us(generated, F.col("latest"))
    return a.withColumn("fresh", F.when(age.isNull(), "unknown").when(age <= _DAY_US, "ok").when(age <= 3 * _DAY_US, "warn").otherwise("bad"))


def hourly_trend(df: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """(hour, n) of the last `hours` local hours up to that of `now`, with empty ones."""
    label = lambda ts: F.date_format(ts + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd HH:00")
    frame = df.sparkSession.range(hours).select(label(F.lit(now).cast("timestamp") - F.make_interval(hours=F.col("id").cast("int"))).alias("hour"))
    return frame.join(df.groupBy(label(F.col("ts")).alias("hour")).agg(F.count("*").alias("n")), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def hourly_heatmap(df: DataFrame, now: datetime, days: int = 7, steps: tuple[int, int, int] = (1, 4, 10)) -> DataFrame:
    """(day, hour, n, level) of the last `days` local days by 24 hours, with empty cells; level 0 for none, 4 from the last step on."""
    local = lambda ts: ts + F.expr("INTERVAL 8 HOURS")
    day = F.date_format(F.date_sub(F.to_date(local(F.lit(now).cast("timestamp"))), F.floor(F.col("id") / 24).cast("int")), "yyyy-MM-dd")
    frame = df.sparkSession.range(days * 24).select(day.alias("day"), (F.col("id") % 24).cast("int").alias("hour"))
    counts = df.groupBy(F.date_format(local(F.col("ts")), "yyyy-MM-dd").alias("day"), F.hour(local(F.col("ts"))).alias("hour")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    level = F.when(n >= steps[2], 4).when(n >= steps[1], 3).when(n > steps[0], 2).when(n > 0, 1).otherwise(0)
    return frame.join(counts, ["day", "hour"], "left").select("day", "hour", n.alias("n"), level.alias("level"))


def grid_cells(df: DataFrame, zoom: float, cell: int = 46) -> DataFrame:
    """(cx, cy, n, lat, lng, top): located events by cell of `cell` pixels of the Web Mercator map at `zoom`: number, centroid and gravest risk."""
    world = 256 * 2**zoom
    sine = F.least(F.greatest(F.sin(F.radians("lat")), F.lit(-0.9999)), F.lit(0.9999))
    x, y = (F.col("lng") / 360 + 0.5) * world, (0.5 - F.log((1 + sine) / (1 - sine)) / (4 * math.pi)) * world
    placed = df.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~((F.col("lat") == 0) & (F.col("lng") == 0)))
    return placed.groupBy(F.floor(x / cell).alias("cx"), F.floor(y / cell).alias("cy")).agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.max("risk_rank").alias("top"))


def cell_summary(df: DataFrame, by: list[str], k: int = 2) -> DataFrame:
    """Each cell's events by risk, and its first `k` by risk and time (ties to the smaller n)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("risk_rank"), F.desc_nulls_last("ts"), "n"))
    first = df.withColumn("_p", rank).where(F.col("_p") <= k).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_p", "n"))).alias("_f"))
    counts = df.groupBy(*by).agg(*(F.count_if(F.col("risk_rank") == i).alias(name) for i, name in enumerate(("low", "medium", "high", "critical"), 1)))
    return counts.join(first, by).select(*by, "low", "medium", "high", "critical", F.transform("_f", lambda x: x["n"]).alias("first"))


def feed_gaps(status: DataFrame) -> DataFrame:
    """Feeds that failed, were empty, or gave items of which none was taken, with the reason."""
    reason = F.when(~F.col("ok"), "failed").when(F.col("items") <= 0, "empty").when(F.col("normalized") <= 0, "not normalised")
    return status.select("label", reason.alias("reason")).where("reason is not null")


def score_labels(df: DataFrame) -> DataFrame:
    """Rows, share of equal categories and risks, and share underestimated by two levels or more, of (category, human_category, rank, human_rank); blank human labels do not count."""
    share = lambda c: F.when(F.count("*") > 0, F.round(F.count_if(c) / F.count("*"), 4))
    good = df.where("trim(coalesce(human_category, '')) <> '' and human_rank is not null")
    return good.agg(F.count("*").alias("n"), share(F.col("category") == F.col("human_category")).alias("category_rate"), share(F.col("rank") == F.col("human_rank")).alias("risk_rate"), share(F.col("human_rank") - F.col("rank") >= 2).alias("severe_rate"))


def confusions(df: DataFrame, k: int = 10) -> DataFrame:
    """The `k` most frequent pairs of different categories."""
    return df.where("trim(coalesce(human_category, '')) <> '' and category <> human_category").groupBy("human_category", "category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "human_category", "category").limit(k)


def size_audit(df: DataFrame, most_bytes: int) -> DataFrame:
    """(file, size, over) of the files that `df` reads."""
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).distinct().withColumn("over", F.col("size") > most_bytes)


def newest_age(df: DataFrame, now: datetime, category: str | None = None) -> DataFrame:
    """The newest time (of a category, or of all) and its age in days, rounded up; null without any."""
    some = df if category is None else df.where(F.col("category") == category)
    return some.agg(F.max("ts").alias("newest")).withColumn("days", F.ceil(_age_us(now, F.col("newest")) / _DAY_US))


def category_briefs(df: DataFrame, categories: int = 4, k: int = 20) -> DataFrame:
    """The first `k` events, in brief order, of the `categories` with most events."""
    top = df.groupBy("category").agg(F.count("*").alias("volume")).orderBy(F.desc("volume"), "category").limit(categories)
    w = Window.partitionBy("category").orderBy(F.desc_nulls_last("risk_rank"), F.desc_nulls_last("ts"), "n")
    return df.join(F.broadcast(top), "category").withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k)


def source_registry(definitions: DataFrame, current: DataFrame, previous: DataFrame, status: DataFrame) -> DataFrame:
    """(key, n, n_previous, state) of each definition (key, datasets, prefix): its events now and before; none that has neither events nor a status. A definition's state is its status, else ok if it has events now, else stale."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        d = small(definitions).alias("d")
        hit = F.array_contains("d.datasets", F.col("e.dataset")) | F.coalesce(F.col("e.id").startswith(F.col("d.prefix")), F.lit(False))
        return df.alias("e").join(d, hit).groupBy("d.key").agg(F.count("*").alias(name))

    out = definitions.select("key").join(counts(current, "n"), "key", "left").join(counts(previous, "n_previous"), "key", "left").join(status.select("key", "state"), "key", "left")
    out = out.where("n is not null or n_previous is not null or state is not null")
    state = F.coalesce("state", F.when(F.col("n") > 0, "ok").otherwise("stale"))
    return out.select("key", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_previous", F.lit(0)).alias("n_previous"), state.alias("state"))


def normalized_by_feed(df: DataFrame, status: DataFrame, feed: str = "source_name") -> DataFrame:
    """The feeds' status with the events that each gave; feeds that this run lacks are `restored`."""
    counts = df.groupBy(F.col(feed).alias("label")).agg(F.count("*").alias("normalized"))
    return status.select("label", "ok", "items").join(counts, "label", "full").select("label", F.coalesce("ok", F.lit(True)).alias("ok"), F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("normalized", F.lit(0)).alias("normalized"), F.col("ok").isNull().alias("restored"))


def today_counts(df: DataFrame, now: datetime, fetched: str, least: int) -> DataFrame:
    """By scope today's events (local day of fetching, else of the event), and whether they reach `least`."""
    local = lambda ts: F.to_date(ts + F.expr("INTERVAL 8 HOURS"))
    today = local(F.coalesce(F.col(fetched), F.col("ts")).cast("timestamp")) == local(F.lit(now).cast("timestamp"))
    return df.groupBy("scope").agg(F.count_if(today).alias("today"), F.count("*").alias("n")).withColumn("enough", F.col("today") >= least)


def extent(df: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """By scope the smallest and largest coordinates of displayable events, domestic ones within the bounds only."""
    there = F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~((F.col("lat") == 0) & (F.col("lng") == 0))
    inside = (F.col("scope") != "domestic") | (F.col("lat").between(south, north) & F.col("lng").between(west, east))
    return df.where(there & inside).groupBy("scope").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"))
