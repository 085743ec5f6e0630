"""Queries of state across runs, audits and look-ups, on two overlapping runs of the events and tables derived from them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconframe.operators import audits as Q
from beaconframe.operators import incremental as I
from beaconframe.operators import lookup as L
from beaconframe.operators import rollups
from beaconframe.operators.reports import preview_records, report_differences
from beaconframe.operators.search import PostingIndex
from beaconframe.operators.state import scratch_path
from beaconframe.plans.bindings import EVENTS_SQL, SOURCES_SQL, events, sources
from beaconframe.plans.graph import _C as _CLUSTERS
from beaconframe.plans.graph import BLOCKED, _edges, _members
from beaconframe.plans.registry import Registry

query = Registry()
NOW = datetime(2024, 1, 20)
_NOW = "TIMESTAMP '2024-01-20 00:00:00'"
_B = f"WITH {EVENTS_SQL}"
_RUNS = f"{_B}, x AS (SELECT * FROM b WHERE n % 3 <> 0), y AS (SELECT * FROM b WHERE n % 3 <> 1)"
_S = f"{_B}, {SOURCES_SQL}"


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A fresh run (n not 0 mod 3) and an old one (n not 1 mod 3)."""
    e = events(spark, d)
    return e.where("n % 3 <> 0"), e.where("n % 3 <> 1")


@query(f"{_RUNS} SELECT x.n, y.n IS NOT NULL AND NOT (y.ts < {_NOW} - INTERVAL 10 DAY) AS reused FROM x LEFT JOIN y ON y.id = x.id")
def j05_cache(spark: SparkSession, d: str) -> DataFrame:
    fresh, old = _runs(spark, d)
    reused, new = I.partition_by_cache(fresh, old.select("id", F.col("ts").alias("fetched")), "id", NOW, timedelta(days=10))
    return reused.select("n", F.lit(True).alias("reused")).union(new.select("n", F.lit(False)))


@query(f"{_RUNS} SELECT n FROM x WHERE entity NOT IN (SELECT entity FROM y WHERE category = 'view')")
def j06_exclude_enriched(spark: SparkSession, d: str) -> DataFrame:
    fresh, old = _runs(spark, d)
    return I.exclude_enriched(fresh, old.where("category = 'view'"), "entity").select("n")


@query(f"{_B}, p AS (SELECT n, CASE WHEN n % 2 = 0 THEN 'pcc-police-' ELSE 'x-' END || n AS id FROM b), o AS (SELECT 'pcc-' || n AS id FROM b WHERE n % 4 = 0) SELECT n FROM p WHERE NOT (id LIKE 'pcc-police-%' AND replace(id, 'pcc-police-', 'pcc-') IN (SELECT id FROM o))")
def j08_drop_shadowed(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("n")
    key = F.col("n").cast("string")
    return I.drop_shadowed(e.withColumn("id", F.concat(F.when(F.col("n") % 2 == 0, "pcc-police-").otherwise("x-"), key)), e.where("n % 4 = 0").select(F.concat(F.lit("pcc-"), key).alias("id")), "pcc-police-", "pcc-").select("n")


_ROWS = """p AS (SELECT k AS row, CASE WHEN k % 2 = 0 THEN 'key' || k ELSE '' END AS key, dataset, type AS name, last_success AS "at" FROM r), c AS (SELECT k AS row, CASE WHEN k % 3 = 0 THEN 'key' || k ELSE '' END AS key, CASE WHEN k % 4 = 1 THEN '' ELSE dataset END AS dataset, CASE WHEN k % 5 = 0 THEN '' ELSE type END AS name FROM r),
m AS (SELECT c.row, 1 AS priority, p.row AS prow, "at" FROM c JOIN p ON c.key <> '' AND c.key = p.key AND c.dataset IN ('', p.dataset) AND c.name IN ('', p.name) UNION ALL SELECT c.row, 2, p.row, "at" FROM c JOIN p ON c.dataset <> '' AND c.dataset = p.dataset AND c.name IN ('', p.name) UNION ALL SELECT c.row, 3, p.row, "at" FROM c JOIN p ON c.name <> '' AND c.name = p.name)"""


@query(f"{_S}, {_ROWS} SELECT c.row, priority, prow AS previous_row, \"at\" FROM c LEFT JOIN m ON m.row = c.row QUALIFY row_number() OVER (PARTITION BY c.row ORDER BY priority, prow) = 1")
def j09_previous_source(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d)
    k = F.col("k")
    key = lambda m: F.when(k % m == 0, F.concat(F.lit("key"), k.cast("string"))).otherwise("")
    previous = s.select(k.alias("row"), key(2).alias("key"), "dataset", F.col("type").alias("name"), F.col("last_success").alias("at"))
    current = s.select(k.alias("row"), key(3).alias("key"), F.when(k % 4 == 1, "").otherwise(F.col("dataset")).alias("dataset"), F.when(k % 5 == 0, "").otherwise(F.col("type")).alias("name"))
    return I.previous_source(current, previous)


@query(
    f"""{_S}, e AS (SELECT dataset, max(ts) AS ev FROM b WHERE n % 2 = 0 GROUP BY dataset), s AS (SELECT dataset, k % 3 = 0 AS ok, k % 4 = 1 AS skipped, k % 7 <> 5 AS configured, CASE WHEN k % 3 <> 0 THEN 'e' || k END AS error FROM r),
p AS (SELECT dataset, CASE WHEN k % 2 = 0 THEN last_success - INTERVAL 1 DAY END AS ls, last_success AS la, last_success - INTERVAL 2 DAY AS f, stale AS st FROM r WHERE k <> 6)
SELECT s.dataset, configured, CASE WHEN ok THEN coalesce(ev, {_NOW}) ELSE coalesce(ls, CASE WHEN NOT coalesce(st, false) THEN f END, ev) END AS last_success, CASE WHEN NOT skipped OR NOT configured THEN {_NOW} ELSE la END AS last_attempt, CASE WHEN skipped AND configured THEN coalesce(st, false) ELSE NOT ok END AS stale, NOT (NOT skipped OR NOT configured) AS skipped, error FROM s LEFT JOIN e USING (dataset) LEFT JOIN p USING (dataset)"""
)
def j10_source_state(spark: SparkSession, d: str) -> DataFrame:
    s, k = sources(spark, d), F.col("k")
    status = s.select("dataset", (k % 3 == 0).alias("ok"), (k % 4 == 1).alias("skipped"), (k % 7 != 5).alias("configured"), F.when(k % 3 != 0, F.concat(F.lit("e"), k.cast("string"))).alias("error"))
    previous = s.where("k <> 6").select("dataset", F.when(k % 2 == 0, F.col("last_success") - F.expr("INTERVAL 1 DAY")).alias("last_success"), F.col("last_success").alias("last_attempt"), (F.col("last_success") - F.expr("INTERVAL 2 DAYS")).alias("fetched"), "stale")
    return I.merge_source_state(status, events(spark, d).where("n % 2 = 0").select("dataset", F.col("ts").alias("fetched")), previous, NOW)


@query(f"{_S}, q AS (SELECT dataset, CASE WHEN k < 4 THEN 'src' || k ELSE '' END AS name, k % 2 = 0 AS stale FROM r), bn AS (SELECT name, bool_and(stale) AS s FROM q WHERE name <> '' GROUP BY name), bd AS (SELECT dataset, bool_and(stale) AS s FROM q GROUP BY dataset) SELECT n, CASE WHEN coalesce(bn.s, bd.s, false) THEN 'stale' ELSE 'fresh' END AS fresh FROM b LEFT JOIN bn ON bn.name = b.source_name LEFT JOIN bd ON bd.dataset = b.dataset")
def j11_event_freshness(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return I.event_freshness(events(spark, d), sources(spark, d).select("dataset", F.when(k < 4, F.concat(F.lit("src"), k.cast("string"))).otherwise("").alias("name"), (k % 2 == 0).alias("stale")))


@query(f"{_S} SELECT k.key, r.dataset FROM (VALUES ('one', 'domestic', ['ds1', 'ds2', 'ds4'], ['none']), ('two', 'international', ['ds3'], ['click', 'view'])) k(key, scope, datasets, categories) JOIN r ON r.scope = k.scope AND (list_contains(k.datasets, r.dataset) OR list_contains(k.categories, r.category))")
def j12_domain_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = [("one", "domestic", ["ds1", "ds2", "ds4"], ["none"]), ("two", "international", ["ds3"], ["click", "view"])]
    return I.domain_sources(spark.createDataFrame(rows, "key string, scope string, datasets array<string>, categories array<string>"), sources(spark, d))


@query(f"{_B}, i AS (SELECT id AS link, min('feed-' || category) AS label FROM b WHERE n % 4 = 0 GROUP BY id) SELECT n, coalesce(i.label, CASE WHEN n % 3 = 0 THEN 'GN ' || category END, source_name) AS label FROM b LEFT JOIN i ON i.link = b.id")
def j17_feed_label(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("link", F.col("id")).withColumn("query", F.when(F.col("n") % 3 == 0, F.concat(F.lit("GN "), "category", F.lit("｜RSS x"))))
    return I.feed_label(e, e.where("n % 4 = 0").select("link", F.concat(F.lit("feed-"), "category").alias("label")))


@query(f"{_RUNS}, s AS (SELECT DISTINCT dataset, CAST(substr(dataset, 3) AS INTEGER) AS k FROM b), st AS (SELECT dataset, k % 2 = 0 AS ok, k % 3 = 1 AS exclusive FROM s WHERE k <> 9) SELECT n, 'fresh' AS run FROM x JOIN st USING (dataset) WHERE ok UNION ALL SELECT n, 'old' FROM y WHERE dataset NOT IN (SELECT dataset FROM st WHERE ok OR exclusive)")
def i01_carry_over(spark: SparkSession, d: str) -> DataFrame:
    fresh, old = (x.select("n", "dataset", F.lit(run).alias("run")) for x, run in zip(_runs(spark, d), ("fresh", "old"), strict=True))
    k = F.substring("dataset", 3, 9).cast("int")
    status = events(spark, d).select("dataset").distinct().where(k != 9).select("dataset", (k % 2 == 0).alias("ok"), (k % 3 == 1).alias("exclusive"))
    return I.carry_over(fresh, old, status).select("n", "run")


_KEY = "CASE WHEN n % 10 = 0 THEN '' ELSE entity END"


@query(f"{_RUNS}, u AS (SELECT n, {_KEY} AS k, 0 AS side, ts, category FROM x UNION ALL SELECT n, {_KEY}, 1, ts, category FROM y), f AS (SELECT * FROM u WHERE category <> 'view' AND epoch_us({_NOW}) - epoch_us(ts) <= 86400000000 * CASE WHEN n % 7 = 0 THEN 15 ELSE 5 END), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY side, n) AS p FROM f) SELECT n, side FROM r WHERE k = '' OR p = 1")
def i02_roll_news(spark: SparkSession, d: str) -> DataFrame:
    fresh, old = (x.withColumn("side", F.lit(i)) for i, x in enumerate(_runs(spark, d)))
    key = F.when(F.col("n") % 10 == 0, "").otherwise(F.col("entity"))
    return I.roll_news(fresh, old, NOW, F.col("category") != "view", key, "n", 5, F.when(F.col("n") % 7 == 0, "advisory"), {"advisory": 15}).select("n", "side")


_POOL = f"""{_RUNS}, p AS (SELECT *, dataset IN ('ds1', 'ds2') AS whole FROM b), fr AS (SELECT *, 0 AS side FROM p WHERE n % 3 <> 0 AND dataset <> 'ds2'), ol AS (SELECT *, 1 AS side FROM p WHERE n % 3 <> 1 AND NOT (whole AND dataset IN (SELECT dataset FROM fr WHERE whole))),
al AS (SELECT * FROM (SELECT * FROM fr UNION ALL SELECT * FROM ol) WHERE whole OR ts >= {_NOW} - INTERVAL 5 DAY), un AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY id ORDER BY side, n) = 1), ro AS (SELECT * FROM un WHERE NOT whole),
dv AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY fraction, risk_rank DESC, n) AS pick, min(n) OVER (PARTITION BY category) AS first FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category, risk_rank ORDER BY ts DESC, n) - 1 AS DOUBLE) / count(*) OVER (PARTITION BY category, risk_rank) AS fraction FROM ro))
SELECT n FROM un WHERE whole UNION ALL SELECT * FROM (SELECT n FROM dv ORDER BY pick, first LIMIT 100)"""


@query(_POOL)
def i03_accumulate(spark: SparkSession, d: str) -> DataFrame:
    fresh, old = (x.withColumn("policy", F.when(F.col("dataset").isin("ds1", "ds2"), "stateful")) for x in _runs(spark, d))
    return I.accumulate(fresh.where("dataset <> 'ds2'"), old, NOW, 5, 100).select("n")


_HOUR = f"""{_B}, ev AS (SELECT n, dataset || ':' || entity AS fp FROM b WHERE n % 2 = 0), kn AS (SELECT DISTINCT dataset || ':' || entity AS fp FROM b WHERE n % 5 = 0), had AS (SELECT count(DISTINCT dataset || ':' || entity) AS h FROM b WHERE n % 35 = 0), bp AS (SELECT fp, count(*) AS k, min(n) AS first FROM ev GROUP BY fp),
fr AS (SELECT * FROM bp WHERE fp NOT IN (SELECT fp FROM kn)), tk AS (SELECT * FROM fr ORDER BY first LIMIT (SELECT greatest(0, 150 - h) FROM had)), t AS (SELECT bp.*, bp.fp IN (SELECT fp FROM kn) AS known, bp.fp IN (SELECT fp FROM tk) AS new FROM bp)"""


def _hourly(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, d).withColumn("fingerprint", F.concat_ws(":", "dataset", "entity"))
    records = e.where("n % 35 = 0").select(F.lit("2024-01-20 08:00").alias("hour"), "fingerprint")
    return I.hourly_run(e.where("n % 2 = 0"), e.where("n % 5 = 0"), records, "2024-01-20 08:00", 150)


@query(f"{_HOUR} SELECT '2024-01-20 08:00' AS hour, CAST(sum(k) AS BIGINT) AS fetched, count(*) AS \"unique\", count(*) FILTER (new) + (SELECT h FROM had) AS new, CAST(coalesce(sum(k) FILTER (known), 0) + coalesce(sum(k - 1) FILTER (new), 0) AS BIGINT) AS duplicate, CAST(coalesce(sum(k) FILTER (NOT known AND NOT new), 0) AS BIGINT) AS deferred, count(*) FILTER (new) + (SELECT h FROM had) >= 200 AS enough FROM t")
def i04_hourly_run(spark: SparkSession, d: str) -> DataFrame:
    return _hourly(spark, d)[0]


@query(f"{_HOUR} SELECT fp AS fingerprint, first FROM tk")
def i04_new_records(spark: SparkSession, d: str) -> DataFrame:
    return _hourly(spark, d)[1].select("fingerprint", "first")


_RUN = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, max(ts) AS \"at\", count(*) AS fetched, count(DISTINCT entity) AS \"unique\", count(DISTINCT dataset) AS new, count(*) - count(DISTINCT entity) AS duplicate, count(*) // 4 AS deferred FROM {x} GROUP BY 1"


@query(f"{_RUNS}, u AS ({_RUN.format(x='y')} UNION ALL {_RUN.format(x='x')}) SELECT hour, max(\"at\") AS \"at\", max(fetched) AS fetched, max(\"unique\") AS \"unique\", arg_max(new, \"at\") AS new, CAST(sum(duplicate) AS BIGINT) AS duplicate, arg_max(deferred, \"at\") AS deferred, count(*) AS attempts FROM u GROUP BY hour HAVING count(DISTINCT \"at\") = count(*)")
def i04_merge_runs(spark: SparkSession, d: str) -> DataFrame:
    """Hours whose two runs ended at different times."""
    def runs(e: DataFrame) -> DataFrame:
        k = F.count("*")
        return e.groupBy(F.date_format("ts", "yyyy-MM-dd HH:00").alias("hour")).agg(F.max("ts").alias("at"), k.alias("fetched"), F.count_distinct("entity").alias("unique"), F.count_distinct("dataset").alias("new"), (k - F.count_distinct("entity")).alias("duplicate"), F.floor(k / 4).alias("deferred"))

    fresh, old = map(runs, _runs(spark, d))
    merged = I.merge_runs(old, fresh)
    twice = old.join(fresh.withColumnRenamed("at", "at2"), "hour").where("at = at2").select("hour")
    return merged.join(twice, "hour", "left_anti")


@query(
    f"""{_B.replace("WITH", "WITH RECURSIVE", 1)}, t AS (SELECT fp AS fingerprint, max(touch) AS touch FROM (SELECT dataset || ':' || entity AS fp, n AS touch FROM b WHERE n % 3 <> 0 UNION ALL SELECT dataset || ':' || entity, n + 500 FROM b WHERE n % 3 = 0) GROUP BY fp),
u AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY touch DESC, fingerprint) AS i, length(fingerprint) + 10 AS size FROM t), g(i, used, kept) AS (SELECT 0::BIGINT, 0::BIGINT, false UNION ALL SELECT u.i, CASE WHEN used + size <= 5003 THEN used + size ELSE used END, used + size <= 5003 FROM g JOIN u ON u.i = g.i + 1) SELECT fingerprint, touch FROM g JOIN u USING (i) WHERE kept"""
)
def i06_bound_ledger(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.concat_ws(":", "dataset", "entity").alias("fingerprint"), "n")
    return I.bound_ledger(e.where("n % 3 <> 0").select("fingerprint", F.col("n").alias("touch")), e.where("n % 3 = 0").select("fingerprint", (F.col("n") + 500).alias("touch")), 5003)


@query(f"{_RUNS}, i AS (SELECT entity, max(ts) AS ts FROM x GROUP BY entity) SELECT y.n, coalesce(i.ts, y.ts) AS ts FROM y LEFT JOIN i ON i.entity = y.entity")
def i07_refresh(spark: SparkSession, d: str) -> DataFrame:
    fresh, old = _runs(spark, d)
    return I.refresh_reused(old, fresh, "entity").select("n", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"{_B} SELECT n, CASE WHEN n % 2 = 0 THEN 'ruled' ELSE category END AS category, CASE WHEN n % 5 = 0 THEN CASE WHEN n % 3 = 0 THEN 'found' ELSE '全國' END ELSE region END AS region FROM b")
def i08_override(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    e = events(spark, d).withColumn("region", F.when(n % 5 == 0, "全國").otherwise(F.col("region")))
    return I.override_category(e, F.lit("ruled"), F.when(n % 2 == 0, "rule:x").otherwise("default"), F.when(n % 3 == 0, "found").otherwise("全國")).select("n", "category", "region")


_AUDIT = f"""{_S}, a AS (SELECT *, round((epoch_us({_NOW}) - epoch_us(coalesce(CASE WHEN k % 3 <> 2 THEN last_success END, CASE WHEN NOT stale THEN last_success - INTERVAL 3 DAY END))) / 3.6e9, 1) AS age, coalesce(max_age_hours, CAST(CASE WHEN type = 'gov-open-data' THEN 48 END AS DOUBLE)) AS lim, k % 7 = 3 AS skipped FROM r),
au AS (SELECT dataset, CASE WHEN type <> 'gov-open-data' THEN CASE WHEN stale OR (type = 'news-rss' AND age > 0) THEN 'news-stale' ELSE 'news' END WHEN NOT configured THEN 'unconfigured' WHEN age <= lim THEN 'ok' WHEN skipped THEN 'skipped' WHEN stale THEN 'fetch-failed' ELSE 'stale' END AS bucket, age AS age_hours, CASE WHEN type = 'gov-open-data' THEN lim END AS "limit" FROM a)"""


def _audit(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    s = sources(spark, d).withColumns({"fetched": F.col("last_success") - F.expr("INTERVAL 3 DAYS"), "skipped": k % 7 == 3}).withColumn("last_success", F.when(k % 3 != 2, F.col("last_success")))
    return Q.freshness_audit(s, NOW)


@query(f"{_AUDIT} SELECT * FROM au")
def q01_freshness_audit(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d)


@query(f"{_AUDIT} SELECT bucket, count(*) AS sources, max(age_hours) AS worst FROM au GROUP BY bucket")
def q01_freshness_summary(spark: SparkSession, d: str) -> DataFrame:
    return Q.freshness_summary(_audit(spark, d))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return sources(spark, d).select(F.col("dataset").alias("name"), (F.col("k") % 2 == 0).alias("required"), (F.col("k") % 3 != 0).alias("ok"))


@query(f"{_AUDIT} SELECT CASE WHEN k % 2 = 0 THEN 'fail' ELSE 'warn' END AS level, 'request' AS kind, dataset AS subject FROM r WHERE k % 3 = 0 UNION ALL SELECT CASE WHEN bucket = 'stale' THEN 'fail' ELSE 'warn' END, bucket, dataset FROM au WHERE bucket IN ('stale', 'fetch-failed', 'skipped') UNION ALL SELECT 'fail', 'coverage', category FROM (SELECT category, count(*) AS o FROM b GROUP BY category) WHERE o < 200")
def q02_source_health(spark: SparkSession, d: str) -> DataFrame:
    coverage = events(spark, d).groupBy(F.col("category").alias("key")).agg(F.count("*").alias("observed")).withColumn("least", F.lit(200))
    return Q.source_health(_requests(spark, d), _audit(spark, d), coverage)


@query(f"{_S} SELECT count(*) AS attempted, count(*) FILTER (k % 3 <> 0) AS successful, round(100.0 * count(*) FILTER (k % 3 <> 0) / count(*), 2) AS rate FROM r")
def q02_success_rate(spark: SparkSession, d: str) -> DataFrame:
    return Q.success_rate(_requests(spark, d))


@query(f"{_RUNS}, a AS (SELECT category, region, count(*) AS k FROM x GROUP BY ALL), e AS (SELECT category, region, count(*) AS k FROM y GROUP BY ALL) SELECT category, region, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' ELSE 'different' END AS difference FROM a FULL JOIN e USING (category, region) WHERE a.k IS DISTINCT FROM e.k")
def q03_report_diff(spark: SparkSession, d: str) -> DataFrame:
    a, e = (x.groupBy("category", "region").agg(F.count("*").alias("k")) for x in _runs(spark, d))
    return Q.report_diff(a, e, ["category", "region"])


@query(
    f"""{_B}, g AS (SELECT dataset || ':' || region AS key, count(*) AS c FROM b GROUP BY ALL) SELECT key, 'report' AS path, 'missing' AS difference FROM g WHERE c % 11 = 0 UNION ALL SELECT key, 'report.counts.low', 'value' FROM g WHERE c % 11 <> 0 AND c % 4 = 0
UNION ALL SELECT key, 'report.days', 'length' FROM g WHERE c % 11 <> 0 AND c % 4 = 1 UNION ALL SELECT key, 'report.meta[1].b', 'keys' FROM g WHERE c % 11 <> 0 AND c % 4 = 2 UNION ALL SELECT key, 'report.name', 'type' FROM g WHERE c % 11 <> 0 AND c % 7 = 0"""
)
def q03_nested_differences(spark: SparkSession, d: str) -> DataFrame:
    """Reports of each dataset and region, with objects in arrays, against others that differ in a value, a length, the keys or a type, or are missing."""
    g = events(spark, d).groupBy(F.concat_ws(":", "dataset", "region").alias("key")).agg(F.count("*").alias("c"), F.count_if(F.col("risk") == "low").alias("low"), F.count_if(F.col("risk") == "high").alias("high"), F.array_sort(F.collect_set(F.to_date("ts").cast("string"))).alias("days"))
    c = F.col("c")

    def report(name, low, days, more):
        text = (F.lit('{"name": '), name, F.lit(', "counts": {"low": '), low.cast("string"), F.lit(', "high": '), F.col("high").cast("string"), F.lit('}, "days": '), F.to_json(days), F.lit(', "meta": [{"a": 1}, {"b": {"x": null'), more, F.lit("}}]}"))
        return F.concat(*text)

    name, none = F.concat(F.lit('"'), "key", F.lit('"')), F.lit("")
    actual = g.where(c % 11 != 0).select("key", report(name, F.col("low"), F.col("days"), none).alias("text"))
    longer = F.when(c % 4 == 1, F.concat("days", F.array(F.lit("x")))).otherwise(F.col("days"))
    expected = g.select("key", report(F.when(c % 7 == 0, "[7]").otherwise(name), F.when(c % 4 == 0, F.col("low") + 1).otherwise(F.col("low")), longer, F.when(c % 4 == 2, ', "y": 2').otherwise(none)).alias("text"))
    return report_differences(actual, expected, "key", "text").select("key", "path", "difference")


@query(f"{_B} SELECT unnest(['row sums', 'unique keys', 'grid size', 'daily axis', 'counts']) AS \"check\", count(*) > 0 AS ok FROM b")
def q04_check_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    sizes = e.agg(F.count_distinct("region"), F.count_distinct("category")).first()
    return Q.check_coverage(rollups.coverage_matrix(e), rollups.coverage_grid(e, NOW), *sizes, 7)


_CONFIG = "cf AS (SELECT category AS domain, CASE WHEN k % 8 = 7 THEN '' ELSE dataset END AS source, CASE WHEN k % 4 = 3 THEN 'ftp://x' ELSE 'https://x.example/' || k END AS url, k % 3 = 0 AS enabled FROM r UNION ALL SELECT category, dataset, 'https://twice.example', false FROM r WHERE k = 2 UNION ALL SELECT 'extra', 'ds99', 'https://y.example', true)"


@query(f"{_S}, {_CONFIG} SELECT domain, source, CASE WHEN source = '' THEN 'no identity' ELSE 'bad address' END AS finding FROM cf WHERE source = '' OR url LIKE 'ftp%' UNION ALL SELECT domain, source, 'repeated' FROM cf GROUP BY domain, source HAVING count(*) > 1 UNION ALL SELECT domain, NULL, 'none enabled' FROM cf GROUP BY domain HAVING NOT bool_or(enabled) UNION ALL SELECT DISTINCT domain, source, 'not observed' FROM cf WHERE enabled AND source NOT IN (SELECT dataset FROM r)")
def q05_domain_config(spark: SparkSession, d: str) -> DataFrame:
    s, k = sources(spark, d), F.col("k")
    url = F.when(k % 4 == 3, "ftp://x").otherwise(F.concat(F.lit("https://x.example/"), k.cast("string")))
    config = s.select(F.col("category").alias("domain"), F.when(k % 8 == 7, "").otherwise(F.col("dataset")).alias("source"), url.alias("url"), (k % 3 == 0).alias("enabled"))
    config = config.union(s.where("k = 2").select("category", "dataset", F.lit("https://twice.example"), F.lit(False))).union(spark.createDataFrame([("extra", "ds99", "https://y.example", True)], config.schema))
    return Q.check_domain_config(config, s)


@query(f"{_B}, s AS (SELECT 100.0 * count(*) FILTER (risk = 'high') / count(*) AS h, 100.0 * count(*) FILTER (risk = 'medium') / count(*) AS m FROM b) SELECT 'high' AS warning, round(h, 1) AS value FROM s WHERE h > 10 UNION ALL SELECT 'medium', round(m, 1) FROM s WHERE m < 45")
def q06_risk_warnings(spark: SparkSession, d: str) -> DataFrame:
    return Q.risk_warnings(events(spark, d), 10, 20, 45)


@query(f"{_B} SELECT id, unnest(list_filter([CASE WHEN n % 10 = 0 THEN 'query label as name' END, CASE WHEN n % 7 = 0 AND n % 2 = 0 THEN 'aggregator not declared' END, CASE WHEN n % 11 = 0 AND n % 3 <> 0 THEN 'zero coordinates' END, CASE WHEN n % 5 = 0 AND n % 2 = 0 THEN 'aggregated without aggregator' END], lambda x: x IS NOT NULL)) AS rule FROM b")
def q07_provenance(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    return Q.provenance_violations(events(spark, d).select(
        "id", F.concat(F.when(n % 10 == 0, "GN ").otherwise(""), "source_name").alias("name"), F.when(n % 7 == 0, "https://news.google.com/x").otherwise("https://x").alias("url"), F.when(n % 2 == 1, "Google News").alias("aggregator"),
        F.when(n % 11 == 0, 0.0).otherwise(F.col("lat")).alias("lat"), F.when(n % 11 == 0, 0.0).otherwise(F.col("lng")).alias("lng"), F.when(n % 3 == 0, "global").otherwise("city").alias("precision"), F.when(n % 5 == 0, "aggregated").alias("confidence"),
    ))


@query(f"{_B} SELECT unnest(['events', 'edges', 'ends', 'form', 'unique', 'clusters', 'enough']) AS \"check\", count(*) > 0 AS ok FROM b")
def q08_check_graph(spark: SparkSession, d: str) -> DataFrame:
    from beaconframe.operators import graph as G

    s, e = _edges(spark, d)
    members = G.clusters(e, BLOCKED)
    return Q.check_graph(s, e, members, G.graph_stats(s, e, members, BLOCKED))


@query(f"{_CLUSTERS}, sz AS (SELECT cluster, count(*) AS k FROM cl GROUP BY cluster) SELECT max(k) AS largest FROM sz HAVING max(k) > 4")
def q09_graph_warnings(spark: SparkSession, d: str) -> DataFrame:
    members = _members(spark, d)[2]
    return Q.graph_warnings(members.groupBy("cluster").count().agg(F.max("count").alias("largest")), 4)


@query(f"{_S} SELECT 'source' AS gate, dataset AS subject FROM (SELECT dataset, k FROM r WHERE k % 2 = 0 UNION ALL SELECT 'ds77', 3) WHERE dataset = 'ds77' OR k % 4 = 0 OR k % 6 = 2 UNION ALL SELECT 'minimum', category FROM (SELECT category, count(*) AS v FROM b GROUP BY category) WHERE v < 200")
def q10_gates(spark: SparkSession, d: str) -> DataFrame:
    s, k = sources(spark, d), F.col("k")
    status = s.select(F.col("dataset").alias("path"), (k % 4 != 0).alias("ok"), (k % 6 == 2).alias("skipped"))
    required = s.where("k % 2 = 0").select(F.col("dataset").alias("path")).union(spark.createDataFrame([("ds77",)], "path string"))
    return Q.pipeline_gates(status, required, events(spark, d).groupBy(F.col("category").alias("name")).agg(F.count("*").alias("value")).withColumn("least", F.lit(200)))


@query(f"{_S}, q AS (SELECT dataset, 90 AS least FROM r UNION ALL SELECT 'ds55', 1) SELECT q.dataset, CASE WHEN r.events IS NULL THEN 'absent' WHEN stale THEN 'stale' ELSE 'too few' END AS finding FROM q LEFT JOIN r USING (dataset) WHERE r.events IS NULL OR stale OR r.events < least")
def q11_landed(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d)
    return Q.landed_check(s, s.select("dataset", F.lit(90).alias("least")).union(spark.createDataFrame([("ds55", 1)], "dataset string, least int")))


@query(
    """SELECT 'customers' AS source, c_name AS text FROM customer WHERE contains(lower(c_name), '00012') OR contains(lower(c_mktsegment), '00012') UNION ALL SELECT 'suppliers', s_name FROM supplier WHERE contains(lower(s_name), '00012') UNION ALL SELECT 'parts', p_name FROM part WHERE contains(lower(p_name), '00012') OR contains(lower(p_brand), '00012')"""
)
def l01_fraud_lookup(spark: SparkSession, d: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    return L.fraud_lookup({"customers": (read("customer"), ["c_name", "c_mktsegment"]), "suppliers": (read("supplier"), ["s_name"]), "parts": (read("part"), ["p_name", "p_brand"])}, " 00012 ")


@query("SELECT count(*) AS hits, CASE WHEN count(*) > 0 THEN 'listed' ELSE 'not listed' END AS verdict FROM supplier WHERE contains(lower(s_name), '0001')")
def l01_verdict(spark: SparkSession, d: str) -> DataFrame:
    return L.fraud_verdict(L.fraud_lookup({"suppliers": (spark.read.parquet(f"{d}/supplier.parquet"), ["s_name"])}, "0001"))


@query("SELECT doc_id AS id, source AS title, substr(text, 1, 300) AS text FROM documents WHERE contains(lower(source), 'er') OR contains(lower(text), 'er') ORDER BY doc_id LIMIT 20")
def l02_ruling_search(spark: SparkSession, d: str) -> DataFrame:
    return L.ruling_search(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text"), "ER")


@query("WITH p AS (SELECT p_partkey AS n, p_brand AS licence, p_type AS name, p_name AS english, p_size AS class FROM part), h AS (SELECT * FROM p WHERE contains(lower(replace(name, ' ', '')), 'ar') OR contains(lower(replace(english, ' ', '')), 'ar')) SELECT n, licence, name FROM h QUALIFY row_number() OVER (PARTITION BY licence, name, class ORDER BY n) = 1 ORDER BY n LIMIT 20")
def l03_drug_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("n"), F.col("p_brand").alias("licence"), F.col("p_type").alias("name"), F.col("p_name").alias("english"), F.col("p_size").alias("class"))
    return L.drug_lookup(p, "A r").select("n", "licence", "name")


@query("SELECT page_id AS id, url AS title, CAST(page_id % 7 AS VARCHAR) AS organisation, 'html' AS formats FROM pages WHERE contains(lower(url), '1') OR contains(lower(html), 'zzzz') ORDER BY page_id LIMIT 10")
def l04_catalog_search(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("id"), F.col("url").alias("title"), F.col("html").alias("description"), (F.col("page_id") % 7).cast("string").alias("organisation"), F.lit("html").alias("formats"))
    return L.catalog_search(p, "1")


query.sql["l04_catalog_search"] = query.sql["l04_catalog_search"].replace("'zzzz'", "'1'")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, substr(o_orderpriority, 1, 4) AS o_orderpriority, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY orders.o_orderkey LIMIT 50")
def l05_preview(spark: SparkSession, d: str) -> DataFrame:
    """S08, L05."""
    rows, total = L.preview(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority").orderBy("o_orderkey"), 50, 40, 4)
    return rows.withColumn("total", F.lit(total).cast("long"))


query.sql["l05_preview"] = query.sql["l05_preview"].replace("CAST(o_orderkey AS VARCHAR) AS o_orderkey", "substr(CAST(o_orderkey AS VARCHAR), 1, 4) AS o_orderkey")


@query(
    """WITH f AS (SELECT event_id AS n, regexp_extract(props, '"k": *(\\d+)', 1) AS k, 'c' || event_id % 60 AS c FROM events), m AS (SELECT 'k' AS key, min(n) AS n, 0 AS p FROM f UNION ALL SELECT c, min(n), 1 FROM f GROUP BY c), w AS (SELECT key FROM m ORDER BY n, p LIMIT 40), o AS (SELECT * FROM f ORDER BY n LIMIT 50)
SELECT n, 'k' AS key, k AS value, (SELECT count(*) FROM f) AS total FROM o UNION ALL SELECT n, c, '[' || n || ']', (SELECT count(*) FROM f) FROM o WHERE c IN (SELECT key FROM w)"""
)
def l05_record_preview(spark: SparkSession, d: str) -> DataFrame:
    """S08, L05 on records of unlike form: of 61 keys the first 40."""
    e = spark.read.parquet(f"{d}/events.parquet")
    text = F.concat(F.lit('{"k": '), F.regexp_extract("props", r'"k": *(\d+)', 1), F.lit(', "c'), (F.col("event_id") % 60).cast("string"), F.lit('": ['), F.col("event_id").cast("string"), F.lit("]}"))
    rows, _, total = preview_records(e.select(F.col("event_id").alias("n"), text.alias("text")), "text", "n")
    return rows.select("n", F.explode("cells").alias("key", "value"), F.lit(total).cast("long").alias("total"))


@query(f"{_B} SELECT n, title FROM b WHERE contains(lower(title || chr(31) || region || chr(31) || source_name), 'k12 view')")
def l06_indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """L06 by postings, entered in two parts."""
    e = events(spark, d)
    index = PostingIndex(spark, scratch_path(spark, "postings"), "n", ["title", "region", "source_name"], buckets=16)
    index.update(e.where("n % 3 = 0"))
    index.update(e)
    return index.search(e, " K12 View ").select("n", "title")


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(chr(31), text, source)), 'licen')")
def l01_indexed_documents(spark: SparkSession, d: str) -> DataFrame:
    """L01 by postings of whole texts."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")
    index = PostingIndex(spark, scratch_path(spark, "postings"), "doc_id", ["text", "source"], buckets=16)
    index.update(docs)
    return index.search(docs, "Licen").select("doc_id")
