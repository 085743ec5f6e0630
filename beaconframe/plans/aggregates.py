"""Queries of the aggregates on the events and on sources, feeds and runs that are derived from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconframe.operators import aggregates as A
from beaconframe.plans.bindings import EVENTS_SQL, SOURCES_SQL, STATUS_SQL, events, feed_status, sources
from beaconframe.plans.registry import Registry

query = Registry()
NOW = datetime(2024, 1, 20)
_NOW = "TIMESTAMP '2024-01-20 00:00:00'"
_B = f"WITH {EVENTS_SQL}"
_S, _F = f"{_B}, {SOURCES_SQL}", f"{_B}, {STATUS_SQL}"


@query(f"{_B} SELECT risk, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM b), 2) AS pct FROM b GROUP BY risk")
def a05_risk_distribution(spark: SparkSession, d: str) -> DataFrame:
    return A.distribution(events(spark, d), "risk")


@query(f"{_B} SELECT CASE WHEN n % 3 = 0 THEN 'default' ELSE 'rule:' || category END AS basis, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM b), 2) AS pct FROM b GROUP BY 1")
def a06_basis_distribution(spark: SparkSession, d: str) -> DataFrame:
    return A.distribution(events(spark, d).withColumn("basis", F.when(F.col("n") % 3 == 0, "default").otherwise(F.concat(F.lit("rule:"), "category"))), "basis")


@query(f"{_S} SELECT k.key, k.configured, k.enabled, count(r.dataset) AS observed, count(*) FILTER (r.dataset IS NOT NULL AND NOT r.stale AND r.events > 0) AS healthy, max(r.last_success) AS last_success FROM (VALUES ('one', 'domestic', ['ds1', 'ds2', 'ds4'], ['none'], 2, 1), ('two', 'international', ['ds3'], ['click', 'view'], 1, 1), ('three', 'domestic', ['x'], ['y'], 0, 0)) k(key, scope, datasets, categories, configured, enabled) LEFT JOIN r ON r.scope = k.scope AND (list_contains(k.datasets, r.dataset) OR list_contains(k.categories, r.category)) GROUP BY 1, 2, 3")
def a04_domain_coverage(spark: SparkSession, d: str) -> DataFrame:
    domains = spark.createDataFrame([("one", "domestic", ["ds1", "ds2", "ds4"], ["none"]), ("two", "international", ["ds3"], ["click", "view"]), ("three", "domestic", ["x"], ["y"])], "key string, scope string, datasets array<string>, categories array<string>")
    config = spark.createDataFrame([("one", True), ("one", False), ("two", True)], "domain string, enabled boolean")
    return A.domain_coverage(domains, config, sources(spark, d))


def _funnel(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("label", F.concat("dataset", F.lit("-"), "source_name"))
    relevant = e.where("n % 2 = 0 and risk_rank >= 2")
    return A.source_funnel({"raw": e, "unique": e.where("n % 2 = 0"), "relevant": relevant, "before": relevant, "final": relevant.where("risk_rank >= 3 and source_name <> 'src1'")})


_FUNNEL = f"""{_B}, c AS (SELECT dataset || '-' || source_name AS label, count(*) AS raw, count(*) FILTER (n % 2 = 0) AS uniq, count(*) FILTER (n % 2 = 0 AND risk_rank >= 2) AS relevant, count(*) FILTER (n % 2 = 0 AND risk_rank >= 3 AND source_name <> 'src1') AS final FROM b GROUP BY 1),
f AS (SELECT *, greatest(0, CASE WHEN relevant > 0 THEN relevant ELSE final END - final) AS dropped, sum(final) OVER () AS total FROM c)"""


@query(
    f"""{_FUNNEL} SELECT label, raw, uniq AS "unique", relevant, final, raw - uniq AS deduped, uniq - relevant AS irrelevant, dropped AS dropped_by_retention, greatest(0, relevant - final) AS dropped_after, round(uniq / raw, 4) AS unique_rate, CASE WHEN uniq > 0 THEN round(relevant / uniq, 4) ELSE 0.0 END AS relevance_rate,
round(final / total, 4) AS final_share, CASE WHEN relevant > 0 AND final = 0 AND dropped > 0 THEN 'dropped_by_retention' WHEN raw >= 3 AND final = 0 THEN 'raw_without_final' WHEN raw >= 10 AND final <= 1 THEN 'low_final_events' END AS reason FROM f"""
)
def a07_source_funnel(spark: SparkSession, d: str) -> DataFrame:
    return _funnel(spark, d).orderBy(*A.contribution_order())


@query(f"{_FUNNEL} SELECT label, raw, final FROM f WHERE raw >= 10 AND final <= 1")
def a08_low_contribution(spark: SparkSession, d: str) -> DataFrame:
    return A.low_contribution(_funnel(spark, d))


@query(f"{_FUNNEL} SELECT label, final FROM f ORDER BY final DESC, relevant DESC, uniq DESC, raw DESC, label LIMIT 25")
def t08_contribution_order(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 feeds in the order of their contribution."""
    return _funnel(spark, d).orderBy(*A.contribution_order()).limit(25).select("label", "final")


@query(f"{_B}, l AS (SELECT category, source_name, dataset, count(*) AS k FROM b GROUP BY ALL) SELECT category, CAST(sum(k) AS BIGINT) AS n, sum(k) >= 200 AS enough, array_to_string(list(source_name || '/' || dataset || '=' || k ORDER BY k DESC, source_name, dataset), ',') AS sources FROM l GROUP BY category")
def a09_source_tree(spark: SparkSession, d: str) -> DataFrame:
    text = F.array_join(F.transform("sources", lambda x: F.concat(x["source_name"], F.lit("/"), x["dataset"], F.lit("="), x["n"].cast("string"))), ",")
    return A.source_tree(events(spark, d), 200).withColumn("sources", text)


@query(f"{_B} SELECT CAST(i AS INTEGER) AS bucket, count(b.n) AS n FROM range(5) t(i) LEFT JOIN b ON ts <= {_NOW} AND (epoch_us({_NOW}) - epoch_us(ts)) // 86400000000 = 4 - i GROUP BY 1")
def a11_rolling_days(spark: SparkSession, d: str) -> DataFrame:
    return A.rolling_day_counts(events(spark, d), NOW)


@query(f"{_B} SELECT strftime({_NOW} - to_days(CAST(i AS INTEGER)), '%Y-%m-%d') AS day, count(b.n) AS n FROM range(5) t(i) LEFT JOIN b ON strftime(ts, '%Y-%m-%d') = strftime({_NOW} - to_days(CAST(i AS INTEGER)), '%Y-%m-%d') GROUP BY 1")
def a12_calendar_days(spark: SparkSession, d: str) -> DataFrame:
    return A.calendar_day_counts(events(spark, d), NOW)


@query(f"{_S} SELECT scope, count(*) AS sources, count(*) FILTER (NOT stale AND epoch_us({_NOW}) - epoch_us(last_success) <= 86400000000) AS active, count(*) FILTER (authority = 'official') AS official, round(100.0 * count(*) FILTER (authority = 'official') / count(*), 2) AS official_pct FROM r GROUP BY scope")
def a13_source_kpi(spark: SparkSession, d: str) -> DataFrame:
    return A.source_kpi(sources(spark, d), NOW)


@query(f"{_F} SELECT count(*) AS n, count(*) FILTER (ok) AS ok, round(count(*) FILTER (ok) / count(*), 4) AS rate, count(*) >= 5 AND count(*) FILTER (ok) < count(*) * 0.5 AS systemic FROM f WHERE gn")
def a14_aggregator_health(spark: SparkSession, d: str) -> DataFrame:
    return A.aggregator_health(feed_status(spark, d))


@query(f"{_F} SELECT count(*) FILTER (ok) AS ok_feeds, CAST(sum(items) AS BIGINT) AS items, count(*) FILTER (ok) >= 10 AND sum(items) >= 100 AS passed FROM f")
def a15_feed_audit(spark: SparkSession, d: str) -> DataFrame:
    return A.feed_audit(feed_status(spark, d), 10, 100)


@query(f"{_B} SELECT count(*) FILTER (authority = 'official') AS official_events, count(DISTINCT source_name) FILTER (authority = 'official') AS official_feeds, count(*) FILTER (authority <> 'official') AS general_events, count(DISTINCT source_name) FILTER (authority <> 'official') AS general_feeds FROM b")
def a16_post_fetch(spark: SparkSession, d: str) -> DataFrame:
    return A.post_fetch_metrics(events(spark, d))


@query(f"{_B} SELECT source_name, category, count(*) AS n, min(dataset) AS dataset, min(ts) AS first, max(ts) AS last FROM b GROUP BY ALL")
def a23_source_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.source_counts(events(spark, d))


@query(f"{_B} SELECT source_name, max(ts) AS latest FROM b WHERE n % 3 <> 0 GROUP BY source_name")
def a24_latest_fetched(spark: SparkSession, d: str) -> DataFrame:
    return A.latest_fetched(events(spark, d).withColumn("fetched", F.when(F.col("n") % 3 == 0, "never").otherwise(F.col("ts").cast("string"))), "fetched")


@query(f"{_S}, a AS (SELECT CASE WHEN authority = 'official' THEN 'official' ELSE 'media' END AS channel, count(*) AS sources, CAST(sum(events) AS BIGINT) AS events, max(last_success) AS latest FROM r GROUP BY 1) SELECT *, CASE WHEN epoch_us({_NOW}) - epoch_us(latest) <= 86400000000 THEN 'ok' WHEN epoch_us({_NOW}) - epoch_us(latest) <= 259200000000 THEN 'warn' ELSE 'bad' END AS fresh FROM a")
def a25_channels(spark: SparkSession, d: str) -> DataFrame:
    return A.channel_summary(sources(spark, d), NOW)


@query(f"{_B}, h AS (SELECT strftime({_NOW} + INTERVAL 8 HOUR - to_hours(i), '%Y-%m-%d %H:00') AS hour FROM range(24) t(i)) SELECT h.hour, count(b.n) AS n FROM h LEFT JOIN b ON strftime(b.ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:00') = h.hour GROUP BY 1")
def a26_hourly_trend(spark: SparkSession, d: str) -> DataFrame:
    return A.hourly_trend(events(spark, d), NOW)


@query(f"{_B}, g AS (SELECT strftime({_NOW} + INTERVAL 8 HOUR - to_days(CAST(i // 24 AS INTEGER)), '%Y-%m-%d') AS day, CAST(i % 24 AS INTEGER) AS hour FROM range(168) t(i)), c AS (SELECT g.day, g.hour, count(b.n) AS n FROM g LEFT JOIN b ON strftime(b.ts + INTERVAL 8 HOUR, '%Y-%m-%d') = g.day AND hour(b.ts + INTERVAL 8 HOUR) = g.hour GROUP BY ALL) SELECT *, CASE WHEN n >= 10 THEN 4 WHEN n >= 4 THEN 3 WHEN n > 1 THEN 2 WHEN n > 0 THEN 1 ELSE 0 END AS level FROM c")
def a26_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return A.hourly_heatmap(events(spark, d), NOW)


_XY = "SELECT *, CAST(floor((lng / 360 + 0.5) * 256 * 256 / 46) AS BIGINT) AS cx, CAST(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 256 * 256 / 46) AS BIGINT) AS cy FROM b WHERE lat IS NOT NULL"


@query(f"{_B} SELECT cx, cy, count(*) AS n, round(avg(lat), 5) AS lat, round(avg(lng), 5) AS lng, max(risk_rank) AS top FROM ({_XY}) GROUP BY cx, cy")
def a27_grid_cells(spark: SparkSession, d: str) -> DataFrame:
    return A.grid_cells(events(spark, d), 8).withColumns({"lat": F.round("lat", 5), "lng": F.round("lng", 5)})


@query(f"{_B}, p AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY risk_rank DESC, ts DESC, n) AS p FROM b) SELECT region, count(*) FILTER (risk_rank = 1) AS low, count(*) FILTER (risk_rank = 2) AS medium, count(*) FILTER (risk_rank = 3) AS high, count(*) FILTER (risk_rank = 4) AS critical, array_to_string(list(n ORDER BY p) FILTER (p <= 2), ',') AS first FROM p GROUP BY region")
def a28_cell_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.cell_summary(events(spark, d), ["region"]).withColumn("first", F.array_join(F.col("first").cast("array<string>"), ","))


@query(f"{_F} SELECT label, CASE WHEN NOT ok THEN 'failed' WHEN items <= 0 THEN 'empty' ELSE 'not normalised' END AS reason FROM f WHERE NOT ok OR items <= 0 OR normalized <= 0")
def a29_feed_gaps(spark: SparkSession, d: str) -> DataFrame:
    return A.feed_gaps(feed_status(spark, d))


_LABELLED = "l AS (SELECT d.doc_id, d.lang AS category, CASE WHEN l.quality = 1 THEN d.lang WHEN d.doc_id % 4 = 0 THEN '' ELSE 'other' END AS human_category, CAST(d.doc_id % 4 AS INTEGER) AS rank, CAST(l.toxic * 3 AS INTEGER) AS human_rank FROM documents d JOIN labels l USING (doc_id))"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    human = F.when(F.col("quality") == 1, F.col("lang")).when(F.col("doc_id") % 4 == 0, "").otherwise("other")
    return docs.select("doc_id", "lang").join(labels, "doc_id").select(F.col("lang").alias("category"), human.alias("human_category"), (F.col("doc_id") % 4).cast("int").alias("rank"), (F.col("toxic") * 3).cast("int").alias("human_rank"))


@query(f"WITH {_LABELLED}, g AS (SELECT * FROM l WHERE trim(coalesce(human_category, '')) <> '' AND human_rank IS NOT NULL) SELECT count(*) AS n, round(count(*) FILTER (category = human_category) / count(*), 4) AS category_rate, round(count(*) FILTER (rank = human_rank) / count(*), 4) AS risk_rate, round(count(*) FILTER (human_rank - rank >= 2) / count(*), 4) AS severe_rate FROM g")
def a30_score_labels(spark: SparkSession, d: str) -> DataFrame:
    return A.score_labels(_labelled(spark, d))


@query(f"WITH {_LABELLED} SELECT human_category, category, count(*) AS n FROM l WHERE trim(human_category) <> '' AND category <> human_category GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 10")
def a30_confusions(spark: SparkSession, d: str) -> DataFrame:
    return A.confusions(_labelled(spark, d))


@query(None)
def a31_size_audit(spark: SparkSession, d: str) -> DataFrame:
    return A.size_audit(spark.read.parquet(f"{d}/documents.parquet"), 1 << 20)


@query(f"{_B} SELECT max(ts) AS newest, CAST(ceil((epoch_us(TIMESTAMP '2024-02-10 00:00:00') - epoch_us(max(ts))) / 86400000000) AS BIGINT) AS days FROM b WHERE category = 'view'")
def a32_newest_age(spark: SparkSession, d: str) -> DataFrame:
    return A.newest_age(events(spark, d), datetime(2024, 2, 10), "view")


@query(f"{_B}, t AS (SELECT category, count(*) AS volume FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4) SELECT n, category, volume, CAST(row_number() OVER (PARTITION BY category ORDER BY risk_rank DESC, ts DESC, n) AS INTEGER) AS pick FROM b JOIN t USING (category) QUALIFY pick <= 20")
def a33_category_briefs(spark: SparkSession, d: str) -> DataFrame:
    return A.category_briefs(events(spark, d)).select("n", "category", "volume", "pick")


@query(
    f"""{_B}, d AS (SELECT * FROM (VALUES ('a', ['ds1', 'ds2'], 'none'), ('b', ['x'], 'ev-8'), ('c', ['x'], 'zz'), ('d', ['ds3'], 'none'), ('e', ['x'], 'none')) v(key, datasets, prefix)), s AS (SELECT 'c' AS key, 'failed' AS state),
m AS (SELECT d.key, b.n FROM b JOIN d ON list_contains(d.datasets, b.dataset) OR starts_with(b.id, d.prefix)), c AS (SELECT key, count(*) FILTER (n % 2 = 0 AND key <> 'd') AS n, count(*) FILTER (n % 3 = 0) AS p FROM m GROUP BY key)
SELECT d.key, coalesce(c.n, 0) AS n, coalesce(c.p, 0) AS n_previous, coalesce(s.state, CASE WHEN c.n > 0 THEN 'ok' ELSE 'stale' END) AS state FROM d LEFT JOIN c ON c.key = d.key LEFT JOIN s ON s.key = d.key WHERE c.n > 0 OR c.p > 0 OR s.state IS NOT NULL"""
)
def a34_source_registry(spark: SparkSession, d: str) -> DataFrame:
    rows = [("a", ["ds1", "ds2"], "none"), ("b", ["x"], "ev-8"), ("c", ["x"], "zz"), ("d", ["ds3"], "none"), ("e", ["x"], "none")]
    e = events(spark, d)
    return A.source_registry(spark.createDataFrame(rows, "key string, datasets array<string>, prefix string"), e.where("n % 2 = 0 and dataset <> 'ds3'"), e.where("n % 3 = 0"), spark.createDataFrame([("c", "failed")], "key string, state string"))


query.sql["a34_source_registry"] = query.sql["a34_source_registry"].replace("(n % 2 = 0 AND key <> 'd')", "(n % 2 = 0 AND ds <> 'ds3')").replace("SELECT d.key, b.n FROM b JOIN d", "SELECT d.key, b.n, b.dataset AS ds FROM b JOIN d")


@query(f"{_F}, c AS (SELECT source_name AS label, count(*) AS k FROM b WHERE n % 2 = 0 GROUP BY 1), g AS (SELECT * FROM f WHERE label <> 'src3') SELECT coalesce(g.label, c.label) AS label, coalesce(g.ok, true) AS ok, coalesce(g.items, 0) AS items, coalesce(c.k, 0) AS normalized, g.label IS NULL AS restored FROM g FULL JOIN c ON c.label = g.label")
def a35_normalized_by_feed(spark: SparkSession, d: str) -> DataFrame:
    return A.normalized_by_feed(events(spark, d).where("n % 2 = 0"), feed_status(spark, d).where("label <> 'src3'"))


@query(f"{_B} SELECT scope, count(*) FILTER (CAST(coalesce(CASE WHEN n % 4 = 0 THEN {_NOW} END, ts) + INTERVAL 8 HOUR AS DATE) = CAST({_NOW} + INTERVAL 8 HOUR AS DATE)) AS today, count(*) AS n, count(*) FILTER (CAST(coalesce(CASE WHEN n % 4 = 0 THEN {_NOW} END, ts) + INTERVAL 8 HOUR AS DATE) = CAST({_NOW} + INTERVAL 8 HOUR AS DATE)) >= 100 AS enough FROM b GROUP BY scope")
def a36_today_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.today_counts(events(spark, d).withColumn("fetched", F.when(F.col("n") % 4 == 0, F.lit(NOW))), NOW, "fetched", 100)


@query(f"{_B} SELECT scope, min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east FROM b WHERE lat IS NOT NULL AND (scope <> 'domestic' OR (lat BETWEEN 22.5 AND 25 AND lng BETWEEN 118.5 AND 122)) GROUP BY scope")
def a37_extent(spark: SparkSession, d: str) -> DataFrame:
    return A.extent(events(spark, d), 22.5, 118.5, 25, 122)
