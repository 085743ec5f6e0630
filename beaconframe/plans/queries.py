"""One registered query per operator on the shared tables, each with SQL to hold it against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconframe.operators import evidence, rollups, selection
from beaconframe.functions.rules import risk_by_price, source_kind
from beaconframe.plans import aggregates, graph, history, normalise, rules, scalars
from beaconframe.plans import selection as plan_selection
from beaconframe.plans import sources as plan_sources
from beaconframe.plans.bindings import EVENTS_SQL, SOURCES_SQL, events, sources

#: The queries' clock, always an explicit parameter of the operators.
NOW = datetime(2024, 1, 20)
_NOW = "TIMESTAMP '2024-01-20 00:00:00'"

def _order() -> list:
    return [F.desc("risk_rank"), F.desc("ts"), F.asc("n")]


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping runs: fresh ones (n not 0 mod 3) and old ones (n not 1 mod 3)."""
    e = events(spark, d)
    return e.where("n % 3 <> 0").withColumn("run", F.lit("fresh")), e.where("n % 3 <> 1").withColumn("run", F.lit("old"))


def c04_price_risk(spark: SparkSession, d: str) -> DataFrame:
    """C04 with steps that fit the orders' prices."""
    return spark.read.parquet(f"{d}/orders.parquet").groupBy(risk_by_price(F.col("o_totalprice"), (400_000, 250_000, 100_000)).alias("risk")).agg(F.count("*").alias("n"))


def f01_filter(spark: SparkSession, d: str) -> DataFrame:
    return selection.filter_events(events(spark, d), scope="domestic", min_rank=3, since_days=30, now=NOW).select("id", "category", "region", "risk")


def w01_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return selection.first_wins(events(spark, d).select("entity", "n", "category"), "entity", "n")


def w03_stratified(spark: SparkSession, d: str) -> DataFrame:
    return selection.stratified_order(events(spark, d).select("n", "category", "risk", "ts"), ["category", "risk"], [F.desc("ts"), F.asc("n")]).select("n", F.round("fraction", 6).alias("fraction"))


def w04_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return selection.round_robin(events(spark, d), "category", _order(), 250).select("n", "category", "pick")


def w05_group_floor(spark: SparkSession, d: str) -> DataFrame:
    return selection.group_floor(events(spark, d), "dataset", [F.asc("n")], 3).select("n", "dataset", "pick")


def t03_brief(spark: SparkSession, d: str) -> DataFrame:
    return selection.brief(events(spark, d)).select("n", "risk")


def u02_prefer_union(spark: SparkSession, d: str) -> DataFrame:
    fresh, old = _halves(spark, d)
    return selection.prefer_union(fresh.select("n", "run"), old.select("n", "run"), "n")


def j07_new_events(spark: SparkSession, d: str) -> DataFrame:
    fresh, old = _halves(spark, d)
    return selection.new_events(fresh, old, "n").select("n", "category")


def a01_daily_cells(spark: SparkSession, d: str) -> DataFrame:
    return rollups.daily_cells(events(spark, d))


def a22_max_merge(spark: SparkSession, d: str) -> DataFrame:
    fresh, old = _halves(spark, d)
    return rollups.max_merge(rollups.daily_cells(old), rollups.daily_cells(fresh))


def a02_coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rollups.coverage_matrix(events(spark, d))


def a03_coverage_grid(spark: SparkSession, d: str) -> DataFrame:
    return rollups.coverage_grid(events(spark, d), NOW)


def a10_kpi(spark: SparkSession, d: str) -> DataFrame:
    return rollups.kpi(events(spark, d), NOW)


def q01_freshness(spark: SparkSession, d: str) -> DataFrame:
    return rollups.freshness(events(spark, d), NOW, 48)


def j01_same_incident(spark: SparkSession, d: str) -> DataFrame:
    return evidence.same_incident_pairs(events(spark, d))


def j03_same_entity(spark: SparkSession, d: str) -> DataFrame:
    return evidence.same_entity_pairs(events(spark, d))


def j13_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return evidence.neighbours(evidence.same_entity_pairs(events(spark, d)))


def _entity_edges(e: DataFrame) -> DataFrame:
    """Same entity with one for each common entity."""
    return evidence.same_entity_pairs(e).groupBy("a", "b").agg(F.count("*").alias("weight")).select("a", "b", F.lit("entity").alias("type"), "weight")


def j13_strongest(spark: SparkSession, d: str) -> DataFrame:
    """Same incident with weight 3, same entity with 1, however many events have the entity."""
    return evidence.strongest_of_events(events(spark, d))


def j13_strongest_entity(spark: SparkSession, d: str) -> DataFrame:
    return evidence.strongest_neighbours(_entity_edges(events(spark, d)), 5, ["entity"])


def i05_merge_rollup(spark: SparkSession, d: str) -> DataFrame:
    """With 10 days' retention, since the tables' events may not span 90."""
    fresh, old = _halves(spark, d)
    return rollups.merge_rollup(rollups.daily_cells(old), rollups.daily_cells(fresh), 10)


def a22_calibrate_minimum(spark: SparkSession, d: str) -> DataFrame:
    """Each hour of events is a run; those with a purchase hold a news record."""
    hours = events(spark, d).groupBy(F.date_trunc("hour", "ts").alias("generated_at")).agg(F.count("*").alias("n"), F.bool_or(F.col("category") == "purchase").alias("has_news"))
    runs = hours.withColumn("hour", F.date_format(F.col("generated_at") + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd HH:00"))
    return rollups.calibrate_minimum(runs, NOW)


def g03_components(spark: SparkSession, d: str) -> DataFrame:
    return evidence.clusters(evidence.same_entity_pairs(events(spark, d)))


def a02_full_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return rollups.full_coverage(e, sources(spark, d), source_kind(F.col("source_type"), F.col("authority"), F.lit(None).cast("string")))


def _full_grid(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("authority") == "official", "official").otherwise("news")
    return rollups.full_grid(events(spark, d), NOW, kind, F.when(F.col("n") % 3 == 0, "stale").otherwise("fresh"))


def a03_full_grid(spark: SparkSession, d: str) -> DataFrame:
    return _full_grid(spark, d)


def a03_blind_spots(spark: SparkSession, d: str) -> DataFrame:
    return rollups.blind_spots(_full_grid(spark, d))


#: Modules whose queries are registered with their SQL beside them.
MODULES = (scalars, rules, plan_selection, aggregates, graph, history, normalise, plan_sources)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        c04_price_risk, f01_filter, w01_first_wins, w03_stratified, w04_round_robin, w05_group_floor, t03_brief, u02_prefer_union, j07_new_events, a01_daily_cells,
        a22_max_merge, a02_coverage_matrix, a03_coverage_grid, a10_kpi, q01_freshness, j01_same_incident, j03_same_entity, j13_neighbours, g03_components,
        i05_merge_rollup, a22_calibrate_minimum, j13_strongest, j13_strongest_entity, a02_full_coverage, a03_full_grid, a03_blind_spots,
    )
    found = {f.__name__: f for f in every}
    for module in MODULES:
        found |= module.query.queries
    return found


def _cells(source: str) -> str:
    parts = ["SELECT strftime(ts, '%Y-%m-%d') AS day, 'total' AS dim, 'all' AS value FROM " + source]
    parts += [f"SELECT strftime(ts, '%Y-%m-%d'), '{c}', {c} FROM {source}" for c in ("scope", "risk", "category")]
    return f"SELECT day, dim, value, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


_PAIRS = "freq AS (SELECT entity FROM b GROUP BY entity HAVING count(*) BETWEEN 2 AND 40), pairs AS (SELECT x.n AS a, y.n AS b, x.entity FROM b x JOIN b y ON x.entity = y.entity AND x.n < y.n JOIN freq f ON f.entity = x.entity)"
#: The pairs of all entities, however many events have them.
_ALL_PAIRS = "pairs AS (SELECT x.n AS a, y.n AS b, x.entity FROM b x JOIN b y ON x.entity = y.entity AND x.n < y.n)"


_EDGES = "edges AS (SELECT x.n AS a, y.n AS b, 'incident' AS type, CAST(3 AS BIGINT) AS weight FROM b x JOIN b y ON x.region = y.region AND x.tag = y.tag AND x.n < y.n AND x.source_name <> y.source_name AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 259200000000 UNION ALL SELECT a, b, 'entity', count(*) FROM pairs GROUP BY a, b), ends AS (SELECT a AS node, b AS other, type, weight FROM edges UNION ALL SELECT b, a, type, weight FROM edges)"


def oracle_sql() -> dict[str, str]:
    with_b = f"WITH {EVENTS_SQL}"
    order = "risk_rank DESC, ts DESC, n"
    grid = f"""{with_b}, g AS (SELECT * FROM (SELECT DISTINCT region FROM b), (SELECT DISTINCT category FROM b), (SELECT unnest(['official', 'news']) AS kind), (SELECT strftime({_NOW} + INTERVAL 8 HOUR - to_days(CAST(i AS INTEGER)), '%Y-%m-%d') AS day FROM range(7) t(i))),
c AS (SELECT g.region, g.category, g.kind, g.day, count(b.n) AS n, count(b.n) FILTER (b.n % 3 <> 0) AS fresh FROM g LEFT JOIN b ON b.region = g.region AND b.category = g.category AND strftime(b.ts + INTERVAL 8 HOUR, '%Y-%m-%d') = g.day AND CASE WHEN b.authority = 'official' THEN 'official' ELSE 'news' END = g.kind GROUP BY ALL)"""
    told = {
        "a03_full_grid": f"{grid} SELECT *, n - fresh AS stale FROM c",
        "a03_blind_spots": f"{grid} SELECT region, category, kind, CASE WHEN sum(n) = 0 THEN 'blind' ELSE 'stale only' END AS spot FROM c GROUP BY ALL HAVING sum(fresh) = 0",
        "a02_full_coverage": f"""{with_b}, {SOURCES_SQL}, e AS (SELECT scope, category, count(*) AS events, count(*) FILTER (risk_rank >= 3) AS elevated, count(*) FILTER (lat IS NOT NULL) AS located, count(*) FILTER (source_type = 'gov-open-data' OR authority = 'official') AS official, count(*) FILTER (source_type = 'news-rss' AND authority <> 'official') AS news FROM b GROUP BY GROUPING SETS ((scope, category), (scope))),
s AS (SELECT scope, category, count(*) AS source_rows, count(*) FILTER (configured AND NOT stale) AS healthy, count(*) FILTER (events > 0) AS contributing, count(*) FILTER (authority = 'official') AS official_sources FROM r GROUP BY GROUPING SETS ((scope, category), (scope)))
SELECT coalesce(e.scope, s.scope) AS scope, coalesce(e.category, s.category) AS category, coalesce(events, 0) AS events, coalesce(elevated, 0) AS elevated, coalesce(located, 0) AS located, coalesce(official, 0) AS official, coalesce(news, 0) AS news, coalesce(source_rows, 0) AS source_rows, coalesce(healthy, 0) AS healthy, coalesce(contributing, 0) AS contributing, coalesce(official_sources, 0) AS official_sources
FROM e FULL JOIN s ON e.scope IS NOT DISTINCT FROM s.scope AND e.category IS NOT DISTINCT FROM s.category""",
        "c04_price_risk": "SELECT CASE WHEN o_totalprice >= 400000 THEN 'critical' WHEN o_totalprice >= 250000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'low' END AS risk, count(*) AS n FROM orders GROUP BY 1",
        "f01_filter": f"{with_b} SELECT id, category, region, risk FROM b WHERE scope = 'domestic' AND risk_rank >= 3 AND (ts IS NULL OR ts BETWEEN {_NOW} - INTERVAL 30 DAY AND {_NOW} + INTERVAL 1 DAY)",
        "w01_first_wins": f"{with_b} SELECT entity, n, category FROM b QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n) = 1",
        "w03_stratified": f"{with_b} SELECT n, round((row_number() OVER (PARTITION BY category, risk ORDER BY ts DESC, n) - 1) / count(*) OVER (PARTITION BY category, risk), 6) AS fraction FROM b",
        "w04_round_robin": f"{with_b} SELECT * FROM (SELECT n, category, CAST(row_number() OVER (PARTITION BY category ORDER BY {order}) AS INTEGER) AS pick FROM b) ORDER BY pick, category LIMIT 250",
        "w05_group_floor": f"{with_b} SELECT n, dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY n) AS INTEGER) AS pick FROM b QUALIFY pick <= 3",
        "t03_brief": f"{with_b} SELECT n, risk FROM b ORDER BY {order} LIMIT 20",
        "u02_prefer_union": f"{with_b}, x AS (SELECT n, 'fresh' AS run FROM b WHERE n % 3 <> 0), y AS (SELECT n, 'old' AS run FROM b WHERE n % 3 <> 1) SELECT * FROM x UNION ALL SELECT * FROM y WHERE n NOT IN (SELECT n FROM x)",
        "j07_new_events": f"{with_b}, y AS (SELECT n FROM b WHERE n % 3 <> 1) SELECT n, category FROM b WHERE n % 3 <> 0 AND n NOT IN (SELECT n FROM y)",
        "a01_daily_cells": f"{with_b} {_cells('b')}",
        "a22_max_merge": f"{with_b}, x AS (SELECT * FROM b WHERE n % 3 <> 0), y AS (SELECT * FROM b WHERE n % 3 <> 1) SELECT day, dim, value, max(n) AS n FROM (({_cells('x')}) UNION ALL ({_cells('y')})) GROUP BY ALL",
        "a02_coverage_matrix": f"{with_b} SELECT scope, category, count(*) AS events, count(*) FILTER (risk_rank >= 3) AS elevated, count(DISTINCT source_name) AS sources, count(DISTINCT region) AS regions FROM b GROUP BY GROUPING SETS ((scope, category), (scope))",
        "a03_coverage_grid": f"{with_b}, g AS (SELECT * FROM (SELECT DISTINCT region FROM b), (SELECT DISTINCT category FROM b), (SELECT strftime({_NOW} - to_days(CAST(i AS INTEGER)), '%Y-%m-%d') AS day FROM range(7) t(i))) SELECT g.region, g.category, g.day, count(b.n) AS n FROM g LEFT JOIN b ON b.region = g.region AND b.category = g.category AND strftime(b.ts, '%Y-%m-%d') = g.day GROUP BY ALL",
        "a10_kpi": f"{with_b}, k AS (SELECT count(*) FILTER (ts BETWEEN {_NOW} - INTERVAL 1 DAY AND {_NOW}) AS last, count(*) FILTER (ts >= {_NOW} - INTERVAL 2 DAY AND ts < {_NOW} - INTERVAL 1 DAY) AS previous, count(*) FILTER (ts BETWEEN {_NOW} - INTERVAL 1 DAY AND {_NOW} AND risk_rank >= 3) AS elevated FROM b) SELECT last, previous, last - previous AS delta, elevated, CAST(CASE WHEN last > 0 THEN floor(100 * elevated / last + 0.5) ELSE 0 END AS BIGINT) AS elevated_pct FROM k",
        "q01_freshness": f"{with_b}, l AS (SELECT dataset, CAST(floor((epoch({_NOW}) - floor(epoch(max(ts)))) / 3600) AS BIGINT) AS age_hours FROM b GROUP BY dataset) SELECT dataset, age_hours, CASE WHEN age_hours > 48 THEN 'stale' ELSE 'fresh' END AS bucket FROM l",
        "j01_same_incident": f"{with_b} SELECT x.n AS a, y.n AS b FROM b x JOIN b y ON x.region = y.region AND x.tag = y.tag AND x.n < y.n AND x.source_name <> y.source_name AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 259200000000",
        "j03_same_entity": f"{with_b}, {_PAIRS} SELECT a, b, entity FROM pairs",
        "j13_neighbours": f"{with_b}, {_PAIRS}, both_ways AS (SELECT a AS node, b AS other FROM pairs UNION SELECT b, a FROM pairs) SELECT node, other, CAST(row_number() OVER (PARTITION BY node ORDER BY other) AS INTEGER) AS rank FROM both_ways QUALIFY rank <= 20",
        "i05_merge_rollup": f"{with_b}, x AS (SELECT * FROM b WHERE n % 3 <> 0), y AS (SELECT * FROM b WHERE n % 3 <> 1) SELECT day, dim, value, max(n) AS n FROM (({_cells('x')}) UNION ALL ({_cells('y')})) WHERE day >= (SELECT strftime(max(ts) - INTERVAL 9 DAY, '%Y-%m-%d') FROM x) GROUP BY ALL",
        "a22_calibrate_minimum": f"{with_b}, r AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM b GROUP BY 1 HAVING bool_or(category = 'purchase')), s AS (SELECT n FROM r WHERE h BETWEEN {_NOW} - INTERVAL 7 DAY AND {_NOW} AND h <> {_NOW}) SELECT coalesce(CAST(quantile_disc(n, 0.25) AS BIGINT), 200) AS minimum, count(*) AS sample_size FROM s",
        "j13_strongest": f"{with_b}, {_ALL_PAIRS}, {_EDGES} SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY weight DESC, other, type) AS INTEGER) AS rank FROM ends QUALIFY rank <= 20",
        "j13_strongest_entity": f"{with_b}, {_PAIRS}, {_EDGES} SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY weight DESC, other, type) AS INTEGER) AS rank FROM ends WHERE type = 'entity' QUALIFY rank <= 5",
        "g03_components": f"WITH RECURSIVE {EVENTS_SQL}, {_PAIRS}, e(x, y) AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y) SELECT x AS node, min(y) AS component FROM r GROUP BY x",
    }
    for module in MODULES:
        told |= module.query.sql
    return told
