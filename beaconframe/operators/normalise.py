"""Normalisers: from landed tables to rows of events. One operator for each family; a connector is a configuration."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconframe.functions import rules as R
from beaconframe.functions.dates import iso_week_end
from beaconframe.functions.text import collapse_space, compact, stable_id, title_key
from beaconframe.operators.selection import first_wins


@dataclass
class Config:
    """How a table's rows become events: expressions on its columns. `where`, `order` and `limit` act before."""

    prefix: str
    key: Column
    title: Column
    region: Column
    ts: Column
    category: str
    risk: Column
    summary: Column
    lat: Column = field(default_factory=lambda: F.lit(None).cast("double"))
    lng: Column = field(default_factory=lambda: F.lit(None).cast("double"))
    scope: str = "domestic"
    where: Column | None = None
    order: list[Column] | None = None
    limit: int | None = None


def normalize_rows(df: DataFrame, config: Config, fetched: datetime, carry: tuple[str, ...] = ()) -> DataFrame:
    """Events (id, title, region, lat, lng, ts, category, scope, risk, summary) of rows; a time that cannot be read is that of fetching. `carry` keeps columns of the rows."""
    if config.where is not None:
        df = df.where(config.where)
    if config.order is not None and config.limit is not None:
        df = df.orderBy(*config.order).limit(config.limit)
    return df.select(
        F.concat(F.lit(config.prefix + "-"), config.key.cast("string")).alias("id"), config.title.alias("title"), config.region.alias("region"), config.lat.alias("lat"), config.lng.alias("lng"),
        F.coalesce(config.ts, F.lit(fetched)).alias("ts"), F.lit(config.category).alias("category"), F.lit(config.scope).alias("scope"), config.risk.alias("risk"), compact(config.summary).alias("summary"), *carry,
    )


def normalize_many(frames: dict[str, DataFrame], cap: int, order: str) -> DataFrame:
    """The union of several tables of one form, the first `cap` rows of each in `order`, with its `label`."""
    out = None
    for label, df in frames.items():
        df = df.orderBy(order).limit(cap).withColumn("label", F.lit(label))
        out = df if out is None else out.unionByName(df)
    return out


def dedupe_parties(df: DataFrame, key: list[str], party: str, order: str) -> DataFrame:
    """Of the parties of an accident the one numbered 1, else the first in `order`."""
    rank = F.struct((~F.coalesce(F.col(party) == 1, F.lit(False))).alias("other"), F.col(order).alias("at"), F.struct(*df.columns).alias("row"))
    return df.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.min(rank).alias("m")).select("m.row.*")


def latest_period_join(left: DataFrame, right: DataFrame, period: str, left_value: str, right_value: str) -> DataFrame:
    """The newest period of `left` with both values; the right one is null where that side lacks the period."""
    last = left.agg(F.max(period).alias(period))
    return left.join(F.broadcast(last), period).select(period, left_value).join(right.select(period, right_value), period, "left")


def latest_partition_sums(df: DataFrame, period: str, sums: dict[str, Column]) -> DataFrame:
    """The newest period and its sums, in one row."""
    last = F.broadcast(df.agg(F.max(period).alias(period)))
    return df.join(last, period).groupBy(period).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()))


def group_breakdown(df: DataFrame, key: str, value: Column, most: int | None = None) -> DataFrame:
    """(total, breakdown): sums by `key` as one text, largest first, then by key."""
    by = df.groupBy(key).agg(F.sum(value).alias("v"))
    rows = by.agg(F.sum("v").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("o"), F.col(key).alias("k")))).alias("s"))  # as many entries as there are types
    text = F.transform(F.col("s") if most is None else F.slice("s", 1, most), lambda x: F.concat(x["k"].cast("string"), F.lit(" "), (-x["o"]).cast("string")))
    return rows.select("total", F.array_join(text, "、").alias("breakdown"))


def latest_period_rows(df: DataFrame, period: str) -> DataFrame:
    """The rows of the newest period."""
    return df.join(F.broadcast(df.agg(F.max(period).alias(period))), period)


def unpivot_months(df: DataFrame, label: str, months: list[str], total: str | None = None) -> DataFrame:
    """(label, total, months): twelve columns as one row, the total from its own column or summed, and the months that have a value."""
    values = F.array(*(F.col(m).cast("double") for m in months))
    summed = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    there = F.filter(F.sequence(F.lit(1), F.lit(len(months))), lambda i: F.get(values, i - 1).isNotNull())
    return df.select(label, (F.coalesce(F.col(total).cast("double"), summed) if total else summed).alias("total"), there.alias("months"))


def metrics_from_total_row(df: DataFrame, is_total: Column, metrics: list[str]) -> DataFrame:
    """(metric, value): each metric of the first total row; rows are few, as of a report."""
    names = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    return df.where(is_total).limit(1).select(F.explode(names).alias("x")).select("x.metric", "x.value").where("value is not null")


def weekly_counts_events(df: DataFrame, kind: str, count: str) -> DataFrame:
    """(kind, n, risk): one row for all kinds together (null kind) and one for each kind that occurred, with its weekly risk; the whole has the gravest."""
    by = df.groupBy(kind).agg(F.sum(count).alias("n")).where("n > 0").select(F.col(kind).alias("kind"), "n").withColumn("risk", R.risk_by_weekly(F.col("kind"), F.col("n")))
    gravest = F.max_by("risk", R.risk_rank(F.col("risk")))
    return by.unionByName(by.agg(F.lit(None).cast("string").alias("kind"), F.sum("n").alias("n"), gravest.alias("risk")))


def week_over_week(df: DataFrame, year: str, week: str, value: str) -> DataFrame:
    """The newest week's total, that of the week before it in the table, the change in percent, the week's end and the risk (50 or more high, 20 or more medium)."""
    by = df.groupBy(year, week).agg(F.sum(value).alias("total")).orderBy(F.desc(F.col(year) * 100 + F.col(week))).limit(2)
    rows = by.agg(F.reverse(F.array_sort(F.collect_list(F.struct((F.col(year) * 100 + F.col(week)).alias("w"), "total", F.col(year).alias("y"), F.col(week).alias("k"))))).alias("r"))
    one, two = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    change = F.when(two["total"] > 0, F.round(100 * (one["total"] - two["total"]) / two["total"], 1))
    risk = F.when(one["total"] >= 50, "high").when(one["total"] >= 20, "medium").otherwise("low")
    return rows.select(one["w"].alias("week"), one["total"].alias("total"), two["total"].alias("previous"), change.alias("change"), iso_week_end(one["y"], one["k"]).alias("week_end"), risk.alias("risk"))


def recent_topn(df: DataFrame, now: datetime, days: int, k: int, prefix: str, key: Column, order: str = "n") -> DataFrame:
    """The `k` newest rows of the last `days` days, with an `id` from the SHA-1 of `key`."""
    return df.where(F.col("ts").between(F.lit(now - timedelta(days=days)), F.lit(now))).orderBy(F.desc("ts"), order).limit(k).withColumn("id", stable_id(prefix, key))


def extract_counts(text: Column, words: dict[str, str], steps: tuple[int, int] = (30, 10)) -> Column:
    """Struct of counts named in a text (pattern with one group for each) and the risk by the largest: high and medium from `steps` on."""
    counts = {name: F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("int"), F.lit(0)) for name, pattern in words.items()}
    top = F.greatest(*counts.values(), F.lit(0))
    return F.struct(*(c.alias(n) for n, c in counts.items()), F.when(top >= steps[0], "high").when(top >= steps[1], "medium").otherwise("low").alias("risk"))


def merge_records(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Sparse records as one row: the last value of each column in `order`."""
    return df.agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def lowest_n_with_dim(df: DataFrame, dim: DataFrame, key: str, rate: str, k: int, skip: Column) -> DataFrame:
    """The `k` rows of the lowest rate that are not skipped, joined with a dimension, with the storage risk."""
    return df.where(~F.coalesce(skip, F.lit(False)) & F.col(rate).isNotNull()).orderBy(rate, key).limit(k).join(dim, key, "left").withColumn("risk", R.risk_by_storage(F.col(rate)))


def station_alerts(observations: DataFrame, stations: DataFrame, key: str = "station") -> DataFrame:
    """By region the observations, those in alert, the first three alert stations by name, the gravest risk and the latest time.

    `observations` have (station, ok, level, ts), `stations` (station, name,
    region, first, second, third). Readings that failed, have no level or no
    known region are left out.
    """
    o = observations.where(F.col("ok") & F.col("level").isNotNull()).join(stations.where("region is not null"), key)
    o = o.withColumn("rank", R.risk_rank(R.risk_by_river(F.col("level"), F.col("first"), F.col("second"), F.col("third")), 0))
    names = F.slice(F.array_sort(F.collect_set(F.when(F.col("rank") > 0, F.col("name")))), 1, 3)
    return o.groupBy("region").agg(F.count("*").alias("n"), F.count_if(F.col("rank") > 0).alias("alerts"), names.alias("names"), F.max("rank").alias("rank"), F.max("ts").alias("ts"))


def latest_hour_unpivot(df: DataFrame, site: str, item: str, hours: list[str], stations: DataFrame) -> DataFrame:
    """(site, metrics, hour, lat, lng): of each site and item the last hour with a value, an item map, the latest hour and the station's place."""
    values = F.array(*(F.col(h).cast("double") for h in hours))
    last = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(len(hours) - 1)), lambda i: F.get(values, i).isNotNull()))
    long = df.select(site, item, last.alias("hour"), F.get(values, last).alias("value")).where("hour is not null")
    wide = long.groupBy(site).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(item, "value")))).alias("metrics"), F.max("hour").alias("hour"))
    return wide.join(stations, site, "left").select(site, "metrics", "hour", "lat", "lng")


def supply_ratio(df: DataFrame, total: str, free: str, at: str) -> DataFrame:
    """Totals and free places of rows with a valid total, the latest time, the ratio and its risk (5 % or less high, 10 % or less medium)."""
    good = df.where(F.col(total) > 0)
    s = good.agg(F.sum(total).alias("total"), F.sum(F.greatest(F.lit(0), F.least(F.col(free), F.col(total)))).alias("free"), F.max(at).alias("at"))
    ratio = F.when(F.col("total") > 0, F.round(F.col("free") / F.col("total"), 4))
    return s.withColumn("ratio", ratio).withColumn("risk", F.when(F.col("ratio") <= 0.05, "high").when(F.col("ratio") <= 0.1, "medium").otherwise("low"))


def latest_indicator(df: DataFrame, period: str, columns: list[str]) -> DataFrame:
    """The row of the newest period of six digits, its columns as numbers."""
    return df.where(F.col(period).rlike(r"^\d{6}$")).orderBy(F.desc(period)).limit(1).select(period, *(F.col(c).try_cast("double").alias(c) for c in columns))


def latest_distinct_sample(df: DataFrame, date: str, key: str, order: str, k: int = 8) -> DataFrame:
    """Of the newest date's rows the first of each key, the first `k` in `order`."""
    return first_wins(latest_period_rows(df, date), key, order).orderBy(order).limit(k)


def count_snapshot(df: DataFrame, name: str) -> DataFrame:
    """(name, n): how many rows there are."""
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))


def status_topk(df: DataFrame, dates: list[str], status: str, k: int = 3, most: int = 40) -> DataFrame:
    """(latest, n, statuses): the latest of several date columns, the rows, and the `k` most frequent sane statuses (not too long, no address) with their counts."""
    sane = df.where((F.length(status) <= most) & ~F.col(status).rlike("(?i)https?://|www\\."))
    top = sane.groupBy(status).agg(F.count("*").alias("k")).orderBy(F.desc("k"), status).limit(k).agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), F.col(status).alias("s")))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat(x["s"], F.lit(" "), (-x["o"]).cast("string"))), "、")
    latest = F.greatest(*(F.max(d) for d in dates)) if len(dates) > 1 else F.max(dates[0])
    return df.agg(latest.alias("latest"), F.count("*").alias("n")).join(top).select("latest", "n", text.alias("statuses"))


def sum_and_list(df: DataFrame, name: str, value: str) -> DataFrame:
    """(total, items): the sum over rows with a number, and each name with its sum, by name; names are few."""
    by = df.where(F.col(value).isNotNull()).groupBy(name).agg(F.sum(value).alias("v"))
    s = by.agg(F.sum("v").alias("total"), F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), "v"))).alias("s"))
    return s.select("total", F.array_join(F.transform("s", lambda x: F.concat(x["k"], F.lit(" "), x["v"].cast("string"))), "；").alias("items"))


def population_totals(df: DataFrame, sex: str, ages: list[str], district: str, village: str, total: str = "total") -> DataFrame:
    """People over all age columns of the rows for both sexes (of all rows if there are none such), distinct districts and villages."""
    both = F.broadcast(df.agg(F.bool_or(F.col(sex) == total).alias("_both")))
    base = df.join(both).where(~F.coalesce("_both", F.lit(False)) | (F.col(sex) == total))
    people = sum((F.coalesce(F.col(a), F.lit(0)) for a in ages[1:]), F.coalesce(F.col(ages[0]), F.lit(0)))
    return base.agg(F.sum(people).alias("people"), F.count_distinct(district).alias("districts"), F.count_distinct(district, village).alias("villages"))


def latest_year(df: DataFrame, year: str, is_total: Column, columns: list[str]) -> DataFrame:
    """The newest year's total row, or the sums of its rows where it has none."""
    rows = latest_period_rows(df, year).withColumn("_t", F.coalesce(is_total, F.lit(False)))
    picked = lambda c: F.coalesce(F.max(F.when(F.col("_t"), F.col(c))), F.sum(c)).alias(c)
    return rows.groupBy(year).agg(*map(picked, columns))


def latest_day_net(df: DataFrame, day: str, net: str, product: str) -> DataFrame:
    """The newest day, its net sum and distinct products."""
    return latest_period_rows(df, day).groupBy(day).agg(F.sum(net).alias("net"), F.count_distinct(product).alias("products"))


def explode_warnings(df: DataFrame, hazards: str) -> DataFrame:
    """One row for each hazard (phenomena, significance, start, end) of a place; hazards without a phenomenon and places without hazards go; the risk is by phenomenon."""
    h = df.select("*", F.explode(hazards).alias("_h")).where("trim(coalesce(_h.phenomena, '')) <> ''")
    return h.select(*[c for c in df.columns if c != hazards], "_h.phenomena", "_h.significance", "_h.start", "_h.end").withColumn("risk", R.risk_by_phenomenon(F.col("phenomena")))


def quake_region(place: Column) -> Column:
    """The county at the beginning of an epicentre's text, else 'offshore'."""
    found = F.regexp_extract(place, r"^(.{2}[縣市])", 1)
    return F.when(found == "", "海域").otherwise(found)


def select_alerts(entries: DataFrame, details: DataFrame, now: datetime, categories: dict[str, str], k: int = 60) -> tuple[DataFrame, DataFrame]:
    """(alerts, funnel): the newest `k` entries (href, category, kind, updated, expires) of known categories that are neither cancelled nor expired, with their details (href, severity, expires); an expired detail drops the alert, one that is missing does not."""
    known = F.col("category").isin(*categories)
    live = known & (F.coalesce(F.col("kind"), F.lit("")) != "Cancel") & (F.col("expires").isNull() | (F.col("expires") >= F.lit(now)))
    chosen = entries.where(live).orderBy(F.desc_nulls_last("updated"), "href").limit(k)
    both = chosen.join(details.select("href", "severity", F.col("expires").alias("_detail")), "href", "left")
    mapped = F.create_map(*(F.lit(x) for pair in categories.items() for x in pair))[F.col("category")]
    kept = both.where(F.col("_detail").isNull() | (F.col("_detail") >= F.lit(now))).select("href", mapped.alias("category"), R.risk_of_alert(F.col("severity")).alias("risk"), "updated")
    counts = entries.agg(F.count("*").alias("entries"), F.count_if(known).alias("known"), F.count_if(live).alias("live"))
    return kept, counts.join(kept.agg(F.count("*").alias("kept")))


def normalize_rulings(df: DataFrame, courts: DataFrame, order: str = "n") -> DataFrame:
    """Rulings (jid, court, title, sentence, outcome, date), the first of each id, with the city of the court's prefix (courts: prefix, city) and the risk of the case."""
    first = first_wins(df, "jid", order)
    cities = courts.select(F.col("prefix").alias("_p"), "city")
    return first.join(cities, F.substring("court", 1, 3) == F.col("_p"), "left").select("jid", "city", "title", "date", R.risk_of_ruling(F.col("title"), F.col("sentence"), F.col("outcome")).alias("risk"))


def normalize_missing(*frames: DataFrame, year: int, token: str = r"token=([^&]+)", order: str = "n") -> DataFrame:
    """Missing persons (name, born, date, picture) of several lists, the first of each token in the picture's address (of name and date without one), with age (null before 1900 or after `year`) and risk."""
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    found = F.nullif(F.regexp_extract(F.coalesce("picture", F.lit("")), token, 1), F.lit(""))
    first = first_wins(every.withColumn("key", F.coalesce(found, F.concat_ws("|", "name", "date"))), "key", order)
    born = F.col("born").try_cast("int")
    age = F.when(born.between(1900, year), year - born)
    return first.select("key", "name", "date", age.alias("age"), R.risk_of_person(age).alias("risk"))


def normalize_travel_warnings(df: DataFrame) -> DataFrame:
    """(region, risk) of travel warnings: what comes before ' - ' in the title, and the level in it."""
    return df.withColumns({"region": F.trim(F.substring_index("title", " - ", 1)), "risk": R.risk_of_travel(F.col("title"))})


def normalize_news(items: DataFrame, relevant: Column, category: Column, risk: Column, region: Column, exclude: DataFrame | None = None, order: str = "n") -> DataFrame:
    """Relevant items, the first of each title key, but for those whose key `exclude` (key) has; with key, category, risk and region."""
    keyed = items.where(relevant).withColumn("key", title_key(F.col("title")))
    first = first_wins(keyed, "key", order)
    if exclude is not None:
        first = first.join(exclude.select("key").distinct(), "key", "left_anti")
    return first.withColumns({"category": category, "risk": risk, "region": region})


#: Categories of official feeds that an item's hint may name; else the first.
OFFICIAL_CATEGORIES = ("治安", "反詐", "協尋")


def official_fallback(items: DataFrame, enriched: DataFrame, key: str = "link") -> DataFrame:
    """Each official item (key, n, title, description, hint, source, ts) as an event.

    It is the enriched event (key, n, title, summary, risk, region, ts, scope,
    source) of its key, set back to the official category and authority; of
    several the one of the smallest title, then risk, then n. An item without
    one becomes an event of its own text, with the risk that C02 gives it.
    `fallback` tells which, `feed` is the item's source.
    """
    kept = ("title", "risk", "n", "summary", "region", "ts", "scope", "source")
    e = enriched.groupBy(key).agg(F.min(F.struct(*kept)).alias("_e"))
    hint, source = F.trim(F.coalesce("hint", F.lit(""))), F.coalesce("source", F.lit("官方來源"))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(source, F.lit(" 警政事件")))
    i = items.withColumns({"_title": title, "_category": F.when(hint.isin(*OFFICIAL_CATEGORIES), hint).otherwise(OFFICIAL_CATEGORIES[0])})
    summary = F.substring(collapse_space(F.coalesce("description", F.lit(""))), 1, 400)
    i = i.withColumn("_summary", F.coalesce(F.nullif(summary, F.lit("")), "_title"))
    none = F.col("_e").isNull()
    own = lambda name, other: F.when(none, other).otherwise(F.col(f"_e.{name}")).alias(name)
    return i.join(e, key, "left").select(
        key, own("title", F.col("_title")), "n", own("risk", R.rate_risk(F.col("_title"), F.col("_category"), F.col("_summary"))), F.col("_category").alias("category"), own("summary", F.col("_summary")), own("region", F.lit("國際")), own("ts", F.col("ts")),
        own("scope", F.lit("international")), F.coalesce("_e.source", "source").alias("source"), F.col("source").alias("feed"), F.lit("official").alias("authority"), F.lit("official-feed-hint").alias("basis"), F.when(none, "official-police-fallback").alias("method"), none.alias("fallback"),
    )
