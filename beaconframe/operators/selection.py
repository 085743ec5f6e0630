"""Filters, first-wins deduplication and stratified selection of events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconframe.operators.ranking import ranked


def filter_events(
    df: DataFrame, *, scope: str | None = None, category: str | None = None, min_rank: int | None = None, source: str | None = None, authority: str | None = None,
    since_days: int | None = None, now: datetime | None = None,
) -> DataFrame:
    """rows that meet every option given. `since_days` drops what is older and what is dated over a day ahead; rows without a time pass."""
    for column, wanted in (("scope", scope), ("category", category), ("source_name", source), ("authority", authority)):
        if wanted is not None:
            df = df.where(F.col(column) == wanted)
    if min_rank is not None:
        df = df.where(F.col("risk_rank") >= min_rank)
    if since_days is not None:
        df = df.where(F.col("ts").isNull() | F.col("ts").between(F.lit(now - timedelta(days=since_days)), F.lit(now + timedelta(days=1))))
    return df


def first_wins(df: DataFrame, key: str | Column, order: str, keep_empty: bool = False) -> DataFrame:
    """The first row of each key in `order` (equal ones: the smallest row), an aggregate with partial results, so no group is held whole.

    Rows with a null or empty key go, or with `keep_empty` all stay.
    """
    key = F.col(key) if isinstance(key, str) else key
    row = F.struct(F.col(order).alias("_at"), F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    blank = F.coalesce(key.cast("string"), F.lit("")) == ""
    first = df.where(~blank).groupBy(key.alias("_key")).agg(F.min(row).alias("_first")).select("_first._row.*")
    return first.unionByName(df.where(blank)) if keep_empty else first


def first_wins_official(df: DataFrame, order: str, title: str = "title", source: str = "source_name", official: str = "authority") -> DataFrame:
    """The first row of each title; official rows count as the same only from one source."""
    own = F.col(official) == "official"
    key = F.when(own & (F.coalesce(F.col(title), F.lit("")) != ""), F.concat_ws("\x1f", title, source)).otherwise(F.col(title))
    return first_wins(df, key, order)


def stratified_order(df: DataFrame, strata: list[str], order: list[Column]) -> DataFrame:
    """`df` with `fraction`, the place of a row within its stratum from 0 up to 1. Sort by fraction, then risk descending, for the full order.

    The places come from ranges of the whole order, so a stratum may hold most rows.
    """
    return ranked(df, strata, order, "_place", "_of").withColumn("fraction", (F.col("_place") - 1) / F.col("_of")).drop("_place", "_of")


def by_risk_time(tie: str = "n") -> list[Column]:
    """Graver first (an unknown risk counts as medium), then newer; rows without a time come last, then by `tie`."""
    return [F.desc(F.coalesce(F.col("risk_rank"), F.lit(2))), F.desc_nulls_last("ts"), F.asc(tie)]


def newest_first(df: DataFrame, order: str = "n") -> DataFrame:
    """`df` with its `place` when the newest comes first; rows without a time come last, equal times go by `order`."""
    return ranked(df, [], [F.desc_nulls_last("ts"), F.asc(order)], "place")


def round_robin(df: DataFrame, group: str, order: list[Column], cap: int) -> DataFrame:
    """The first, second, third ... row of every group in turn until `cap` rows are chosen; Spark keeps `cap` rows of each group at most before the last sort."""
    pick = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("pick", pick).where(F.col("pick") <= cap).orderBy("pick", group).limit(cap)


def select_diverse(df: DataFrame, cap: int, order: str = "n", category: str = "category", otherwise: str = "其他") -> DataFrame:
    """Each category in turn gives its next row until `cap` are chosen; all rows if there are no more than that. Sorted by risk and time.

    Within a category rows come by their place in their risk's stratum (newest
    first), graver ones first at equal places; categories come by first
    appearance in `order`. Ties go to the smaller `order`.
    """
    group = F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit(otherwise))
    keyed = df.withColumn("_group", group)
    first = keyed.groupBy("_group").agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    risk = F.coalesce(F.col("risk_rank"), F.lit(2))
    placed = stratified_order(keyed.withColumn("_risk", risk), ["_group", "_risk"], [F.desc_nulls_last("ts"), F.asc(order)])
    pick = F.row_number().over(Window.partitionBy("_group").orderBy("fraction", F.desc("_risk"), F.asc(order)))
    chosen = placed.withColumn("_pick", pick).where(F.col("_pick") <= cap).join(F.broadcast(first), "_group").orderBy("_pick", "_first").limit(cap)
    return chosen.select(*df.columns).orderBy(*by_risk_time(order))


def group_floor(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first `k` rows of each group, with their place as `pick`."""
    return df.withColumn("pick", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("pick") <= k)


def tiered_union(tiers: list[DataFrame], key: str, cap: int, order: str = "n") -> DataFrame:
    """The first `cap` rows of several tiers, each key from its first tier, with `tier` from 1; within a tier by `order`."""
    every = None
    for i, tier in enumerate(tiers, 1):
        tier = tier.withColumn("tier", F.lit(i))
        every = tier if every is None else every.unionByName(tier)
    row = F.struct(*[F.col(c) for c in every.columns])
    return every.groupBy(key).agg(F.min(F.struct("tier", F.col(order).alias("_at"), row.alias("_row"))).alias("_m")).select("_m._row.*").orderBy("tier", order).limit(cap)


def select_with_floors(df: DataFrame, cap: int, *, official: Column, general: Column, feed: str = "source_name", per_feed: int = 3, least: int = 50, order: str = "n") -> DataFrame:
    """`cap` rows with `tier`: the first `per_feed` of each official feed, then general rows up to `least`, then any, each tier chosen by `select_diverse`."""
    floor = group_floor(df.where(official), feed, [F.asc(order)], per_feed).drop("pick").orderBy(order).limit(cap)
    have = floor.where(general).count()
    want = min(least, cap - floor.count()) - have
    tiers = [floor]
    if want > 0:
        tiers.append(select_diverse(df.where(general).join(floor.select(order), order, "left_anti").select(*df.columns), want, order))
    return tiered_union([*tiers, select_diverse(df, cap, order)], order, cap, order)


def _draw(text: Column) -> Column:
    """A step of a linear generator from the FNV-1a hash of the text's UTF-16 units, both modulo 2^32 (fixed values)."""
    code = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), F.shiftright(F.length(code), 2) - 1), lambda i: F.conv(F.substring(code, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    h = F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(u) * 16777619).bitwiseAND(0xFFFFFFFF))
    return (h * 1664525 + 1013904223).bitwiseAND(0xFFFFFFFF)


def stratified_sample(df: DataFrame, per_cell: int = 5, seed: int = 42, category: str = "category", risk: str = "risk", key: str = "id", order: str = "n") -> DataFrame:
    """`per_cell` rows of each cell of category and risk, with `pick`: those of the smallest draw from seed, cell, id and place in the cell.

    Places count from 0 in `order`; equal draws go by id and place. Rows with a
    blank category or risk are left out. Places come from ranges of the whole
    order, and of a cell no task orders more than it keeps.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = df.where((text(category) != "") & (text(risk) != "")).withColumns({"_c": text(category), "_r": text(risk), "_id": F.coalesce(F.col(key).cast("string"), F.lit(""))})
    placed = ranked(rows, ["_c", "_r"], [F.asc(order)], "_place")
    drawn = placed.withColumn("_draw", _draw(F.concat_ws("|", F.lit(str(seed)), F.concat("_c", F.lit("\0"), "_r"), "_id", (F.col("_place") - 1).cast("string"))))
    w = Window.partitionBy("_c", "_r").orderBy("_draw", "_id", "_place")
    return drawn.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= per_cell).select(*df.columns, "pick")


def brief_order(tie: str = "n") -> list[Column]:
    """Graver first with unknown risks last, then newer with missing times last."""
    return [F.desc_nulls_last("risk_rank"), F.desc_nulls_last("ts"), F.asc(tie)]


def brief(df: DataFrame, k: int = 20) -> DataFrame:
    """The first `k` rows in brief order."""
    return df.orderBy(*brief_order()).limit(k)


def triage(df: DataFrame, acknowledged: DataFrame, cap: int = 30, key: str = "id") -> DataFrame:
    """The first `cap` elevated rows by risk and time, with `unread`, and the counts `unread_total`, `total` and `capped` of all elevated ones."""
    elevated = df.where(F.col("risk_rank") >= 3).join(acknowledged.select(key, F.lit(True).alias("_read")).distinct(), key, "left").withColumn("unread", F.col("_read").isNull()).drop("_read")
    counts = elevated.agg(F.count_if("unread").alias("unread_total"), F.count("*").alias("total")).withColumn("capped", F.greatest(F.lit(0), F.col("total") - cap))
    return elevated.orderBy(F.desc("risk_rank"), F.desc_nulls_last("ts"), F.asc("n")).limit(cap).join(F.broadcast(counts))


def decision_brief(df: DataFrame, domain: str, advice: str, k: int = 6, domains: int = 3, advices: int = 2) -> DataFrame:
    """The first `k` rows of medium risk or more in one row: their number, their first `domains` distinct domains and `advices` distinct recommendations."""
    top = df.where(F.col("risk_rank") >= 2).orderBy(*brief_order()).limit(k).select(F.struct((-F.col("risk_rank")).alias("r"), F.coalesce(-F.unix_micros(F.col("ts").cast("timestamp")), F.lit((1 << 63) - 1)).alias("t"), "n").alias("at"), domain, advice)
    rows = top.agg(F.array_sort(F.collect_list(F.struct("at", domain, advice))).alias("rows"))
    distinct = lambda c, most: F.slice(F.array_distinct(F.transform("rows", lambda r: r[c])), 1, most)
    return rows.select(F.size("rows").alias("n"), distinct(domain, domains).alias("domains"), distinct(advice, advices).alias("advices"))


def newest(df: DataFrame, k: int = 500) -> DataFrame:
    """The `k` newest rows; rows without a time come last."""
    return df.orderBy(F.desc_nulls_last("ts"), F.asc("n")).limit(k)


def deep_candidates(df: DataFrame, has_analysis: Column, k: int = 5, order: str = "n") -> DataFrame:
    """The first `k` high or critical rows that lack an analysis."""
    return df.where((F.col("risk_rank") >= 3) & ~F.coalesce(has_analysis, F.lit(False))).orderBy(order).limit(k)


def prefer_union(fresh: DataFrame, old: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row of each key: of `fresh` if it has the key, else of `old`; within one side the first in `order` (else the smallest row). Rows without a key go."""
    both = fresh.withColumn("_side", F.lit(0)).unionByName(old.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    own = [c for c in both.columns if c != "_side"]
    first = F.struct(F.col("_side"), *([F.col(order).alias("_at")] if order else []), F.struct(*own).alias("_row"))
    return both.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(first).alias("_m")).select("_m._row.*")


def new_events(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Rows whose key `previous` lacks; a null key is always new."""
    return current.join(previous.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*current.columns)


def excluded_counts(every: DataFrame, kept: DataFrame, key: str, by: str) -> DataFrame:
    """How many rows of `every` are not in `kept`, by `by`."""
    return every.join(kept.select(key), key, "left_anti").groupBy(by).agg(F.count("*").alias("excluded"))


def overlap(a: Column, b: Column) -> Column:
    """struct(common, coefficient): size of the intersection, and its share of the smaller set; 0 for empty sets."""
    common = F.size(F.array_intersect(a, b))
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.struct(common.alias("common"), F.when(least > 0, common / least).otherwise(0.0).alias("coefficient"))


def domain_union(*frames: DataFrame) -> DataFrame:
    """All distinct values of the frames' first columns, without nulls."""
    every = frames[0].select(F.col(frames[0].columns[0]).alias("value"))
    for f in frames[1:]:
        every = every.union(f.select(f.columns[0]))
    return every.where("value is not null").distinct()


def merge_keys(previous: DataFrame, current: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All keys of either side with `previous` and `current` values, 0 where a side lacks one."""
    p, c = previous.select(*keys, F.col(value).alias("previous")), current.select(*keys, F.col(value).alias("current"))
    return p.join(c, keys, "full").select(*keys, F.coalesce("previous", F.lit(0)).alias("previous"), F.coalesce("current", F.lit(0)).alias("current"))
