"""The event table and its companions, derived from the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same view in SQL, for oracles; its columns are those of `events`.
EVENTS_SQL = """b AS (SELECT 'ev-' || event_id AS id, event_id AS n, ts, event_type AS category, n_name AS region,
  CASE WHEN event_id % 4 = 0 THEN 'international' ELSE 'domestic' END AS scope,
  CASE WHEN value >= 150 THEN 'critical' WHEN value >= 75 THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END AS risk,
  CASE WHEN value >= 150 THEN 4 WHEN value >= 75 THEN 3 WHEN value >= 25 THEN 2 ELSE 1 END AS risk_rank,
  'src' || (user_id % 7) AS source_name, 'ds' || (event_id % 11) AS dataset,
  'k' || regexp_extract(props, '"k": *(\\d+)', 1) || '-u' || user_id AS entity, 'k' || regexp_extract(props, '"k": *(\\d+)', 1) AS tag,
  'k' || regexp_extract(props, '"k": *(\\d+)', 1) || ' ' || event_type || ' v' || CAST(floor(value / 5) AS BIGINT) AS title,
  CASE WHEN user_id % 17 <> 0 THEN CAST(22 + user_id % 40 / 10 AS DOUBLE) END AS lat, CASE WHEN user_id % 17 <> 0 THEN CAST(118 + user_id % 45 / 10 AS DOUBLE) END AS lng,
  CASE WHEN user_id % 5 = 0 THEN 'official' ELSE 'media' END AS authority, CASE event_id % 3 WHEN 0 THEN 'gov-open-data' WHEN 1 THEN 'news-rss' ELSE 'other' END AS source_type
  FROM events JOIN nation ON n_nationkey = user_id % 25)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: id, n, ts, category, region, scope, risk, risk_rank, source_name, dataset, entity, tag, title, lat, lng, authority, source_type."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("nk"), "n_name")
    k = F.regexp_extract("props", r'"k": *(\d+)', 1)
    rank = F.when(F.col("value") >= 150, 4).when(F.col("value") >= 75, 3).when(F.col("value") >= 25, 2).otherwise(1)
    return raw.join(nation, F.col("user_id") % 25 == F.col("nk")).select(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("id"),
        F.col("event_id").alias("n"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("category"),
        F.col("n_name").alias("region"),
        F.when(F.col("event_id") % 4 == 0, "international").otherwise("domestic").alias("scope"),
        F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), rank).alias("risk"),
        rank.alias("risk_rank"),
        F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")).alias("source_name"),
        F.concat(F.lit("ds"), (F.col("event_id") % 11).cast("string")).alias("dataset"),
        F.concat(F.lit("k"), k, F.lit("-u"), F.col("user_id").cast("string")).alias("entity"),
        F.concat(F.lit("k"), k).alias("tag"),
        F.concat(F.lit("k"), k, F.lit(" "), F.col("event_type"), F.lit(" v"), F.floor(F.col("value") / 5).cast("string")).alias("title"),
        F.when(F.col("user_id") % 17 != 0, 22 + (F.col("user_id") % 40) / 10).alias("lat"),
        F.when(F.col("user_id") % 17 != 0, 118 + (F.col("user_id") % 45) / 10).alias("lng"),
        F.when(F.col("user_id") % 5 == 0, "official").otherwise("media").alias("authority"),
        F.element_at(F.array(F.lit("gov-open-data"), F.lit("news-rss"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int")).alias("source_type"),
    )


#: Sources in SQL, after `b`: one row for each dataset; its columns are those of `sources`.
SOURCES_SQL = """r AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'domestic' ELSE 'international' END AS scope, ['gov-open-data', 'news-rss', 'other'][k % 3 + 1] AS type, CASE WHEN k % 4 = 0 THEN 'official' ELSE 'media' END AS authority,
  k % 10 <> 9 AS configured, k % 5 = 0 AS stale, CAST(CASE WHEN k % 4 = 1 THEN 24 END AS DOUBLE) AS max_age_hours FROM (SELECT dataset, CAST(substr(dataset, 3) AS INTEGER) AS k, max(ts) AS last_success, count(*) AS events, min(category) AS category FROM b GROUP BY dataset))"""

#: Feeds in SQL, after `b`: one row for each source name; its columns are those of `feed_status`.
STATUS_SQL = """f AS (SELECT source_name AS label, substr(source_name, 4) <> '2' AS ok, CASE WHEN substr(source_name, 4) = '4' THEN 0 ELSE count(*) END AS items, CASE WHEN substr(source_name, 4) IN ('4', '5') THEN 0 ELSE count(*) FILTER (n % 2 = 0) END AS normalized,
  CAST(substr(source_name, 4) AS INTEGER) % 2 = 0 AS gn FROM b GROUP BY source_name)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per dataset: dataset, k, last_success, events, category, scope, type, authority, configured, stale, max_age_hours."""
    s = events(spark, sf_dir).groupBy("dataset").agg(F.max("ts").alias("last_success"), F.count("*").alias("events"), F.min("category").alias("category"))
    k = F.substring("dataset", 3, 10).cast("int")
    kinds = F.array(F.lit("gov-open-data"), F.lit("news-rss"), F.lit("other"))
    return s.withColumn("k", k).select(
        "dataset", "k", "last_success", "events", "category", F.when(k % 2 == 0, "domestic").otherwise("international").alias("scope"), F.get(kinds, k % 3).alias("type"),
        F.when(k % 4 == 0, "official").otherwise("media").alias("authority"), (k % 10 != 9).alias("configured"), (k % 5 == 0).alias("stale"), F.when(k % 4 == 1, 24.0).alias("max_age_hours"),
    )


def feed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source name: label, ok, items, normalized, gn."""
    f = events(spark, sf_dir).groupBy(F.col("source_name").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("n") % 2 == 0).alias("even"))
    k = F.substring("label", 4, 10)
    return f.select("label", (k != "2").alias("ok"), F.when(k == "4", 0).otherwise(F.col("n")).alias("items"), F.when(k.isin("4", "5"), 0).otherwise(F.col("even")).alias("normalized"), (k.cast("int") % 2 == 0).alias("gn"))
