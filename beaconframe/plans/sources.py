"""Queries of the sources and sinks: the tables' rows are written as feeds, alerts, pages and envelopes, and read back. One stream too."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconframe.operators.hours import RUNS, by_hour, hourly_runs
from beaconframe.operators.state import materialize, scratch_path
from beaconframe.operators.zorder import read_viewport, write_clustered
from beaconframe.plans.bindings import EVENTS_SQL, events
from beaconframe.plans.registry import Registry
from beaconframe.sources import feeds as S
from beaconframe.sources.envelopes import register
from beaconframe.sources.samples import read_samples, write_samples
from beaconframe.sources.snapshots import SnapshotStore
from beaconframe.streaming import rolling
from beaconframe.streaming.hours import stream_hours

query = Registry()
NOW = datetime(2024, 1, 20)
_B = f"WITH {EVENTS_SQL}"


def _text(*parts) -> F.Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _listed(df: DataFrame, by: str, order: str, block, between: str = "") -> DataFrame:
    """(by, body): the rows' blocks of each group as one text, in order. Groups are a dataset's or source's events of one day at most."""
    return df.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, block.alias("x")))), lambda r: r["x"]), between).alias("body"))


@query(f"{_B} SELECT strftime(ts, '%Y-%m-%d') AS feed, title, CASE WHEN n % 3 = 0 THEN 'https://atom.example/' ELSE 'https://rss.example/' END || n AS link, CASE WHEN n % 3 = 0 THEN 'sum ' || category ELSE 'a b ' || category END AS description, strftime(ts, '%Y-%m-%d') AS published, CASE WHEN n % 3 <> 0 THEN source_name END AS publisher FROM b WHERE n % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY n) <= 20")
def s01_feed_items(spark: SparkSession, d: str) -> DataFrame:
    """A feed for each day, with RSS items, Atom entries and items without a title."""
    n, day = F.col("n"), F.date_format("ts", "yyyy-MM-dd")
    title = F.when(n % 10 == 0, "").otherwise(F.concat(F.lit("<title><![CDATA["), "title", F.lit("]]></title>")))
    rss = _text("<item>", title, "<link>https://rss.example/", n, "</link><description>&lt;b&gt;a&lt;/b&gt; b ", F.col("category"), "</description><pubDate>", day, '</pubDate><source url="https://p.example">', F.col("source_name"), "</source></item>")
    atom = _text("<entry a='1'>", title, '<link rel="x" href="https://atom.example/', n, '"/><summary>sum ', F.col("category"), "</summary><updated>", day, "</updated></entry>")
    docs = _listed(events(spark, d).withColumn("feed", day), "feed", "n", F.when(n % 3 == 0, atom).otherwise(rss), "\n")
    return S.read_feed_items(docs, "body", "feed", 20).select("feed", "title", "link", "description", "published", "publisher")


@query(f"{_B}, f AS (SELECT dataset AS label, CASE WHEN substr(dataset, 3) IN ('1', '2') THEN 'https://news.google.com/' ELSE 'https://x/' END || dataset AS url, CAST(substr(dataset, 3) AS INTEGER) AS k FROM (SELECT DISTINCT dataset FROM b)), c AS (SELECT dataset AS label, count(*) AS items FROM b WHERE n % 2 = 0 GROUP BY 1) SELECT f.label, k < 9 AND k % 4 <> 0 AS ok, coalesce(items, 0) AS items, CASE WHEN k >= 9 THEN 'not attempted' WHEN k % 4 = 0 THEN 'HTTP 500' END AS error, k < 9 AND k % 3 = 0 AS fallback, k IN (1, 2) AS gn FROM f LEFT JOIN c ON c.label = f.label")
def s02_feed_status(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    k = F.substring("label", 3, 9).cast("int")
    catalog = e.select(F.col("dataset").alias("label")).distinct().withColumn("url", F.concat(F.when(k.isin(1, 2), "https://news.google.com/").otherwise("https://x/"), "label"))
    attempts = catalog.where(k < 9).select("label", (k % 4 != 0).alias("ok"), F.when(k % 4 == 0, "HTTP 500").alias("error"), (k % 3 == 0).alias("fallback"))
    return S.feed_status(e.where("n % 2 = 0").select(F.col("dataset").alias("label")), attempts, catalog)


@query(f"{_B} SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(n AS VARCHAR) AS key, category AS kind, NULL AS absent FROM b")
def s04_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """An envelope for each day, with its columns in another order."""
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = _listed(events(spark, d).withColumn("day", day), "day", "n", F.to_json(F.array("category", F.col("n").cast("string"))), ",")
    envelopes = rows.select("day", _text('{"columns":["kind","key"],"rows":[', F.col("body"), "]}").alias("body"))
    return S.rows_as_records(envelopes, "body", ["key", "kind", "absent"]).select("day", "key", "kind", F.col("absent").cast("int").alias("absent"))


query.sql["s04_envelopes"] = query.sql["s04_envelopes"].replace("NULL AS absent", "CAST(NULL AS INTEGER) AS absent")


@query(f"{_B} SELECT strftime(ts, '%Y-%m-%d') AS day, n AS key, category AS kind FROM b")
def s07_open_data(spark: SparkSession, d: str) -> DataFrame:
    """A JSON document for each day: a list, or one under a path, or one a level deeper."""
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = _listed(events(spark, d).withColumn("day", day), "day", "n", F.to_json(F.struct(F.col("n").alias("key"), F.col("category").alias("kind"))), ",")
    third = F.dayofmonth("day") % 3
    body = F.when(third == 0, _text("[", F.col("body"), "]")).when(third == 1, _text('{"records":[', F.col("body"), "]}")).otherwise(_text('{"result":{"records":[', F.col("body"), "]}}"))
    return S.read_open_data(rows.select("day", body.alias("body")), "body", "struct<key:bigint,kind:string>").select("day", "key", "kind")


@query("SELECT s_nationkey AS page, s_name AS name, CAST(s_suppkey AS DOUBLE) AS storage, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey % 100 AS DOUBLE) END AS rate, s_suppkey % 7 = 0 AS planned_empty FROM supplier")
def s09_reservoirs(spark: SparkSession, d: str) -> DataFrame:
    """A page with a table for each nation's suppliers."""
    k = F.col("s_suppkey")
    rate = F.when(k % 7 == 0, "放空").otherwise(_text(k % 100, " %"))
    row = _text("<tr class=x><td><b>", F.col("s_name"), "</b></td><td>", k, "</td><td>-</td><td>", rate, "</td><td>now</td></tr>")
    pages = _listed(spark.read.parquet(f"{d}/supplier.parquet"), "s_nationkey", "s_suppkey", row).select(F.col("s_nationkey").alias("page"), _text("<table><tr><th>a</th></tr>", F.col("body"), "</table>").alias("html"))
    return S.reservoir_rows(pages, "html", ["page"]).select("page", "name", "storage", "rate", "planned_empty")


@query("SELECT s_nationkey AS page, CAST(s_suppkey AS VARCHAR) AS id, 'News of ' || s_name AS title, '113-01-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') AS date FROM supplier")
def s10_links(spark: SparkSession, d: str) -> DataFrame:
    """A page of links for each nation's suppliers, each link twice."""
    k = F.col("s_suppkey")
    a = _text('<a class="y" href="/p?x=1&amp;id=', k, '">News of ', F.col("s_name"), " (113-01-", F.lpad((k % 28 + 1).cast("string"), 2, "0"), ")</a>")
    pages = _listed(spark.read.parquet(f"{d}/supplier.parquet"), "s_nationkey", "s_suppkey", F.concat(a, a)).select(F.col("s_nationkey").alias("page"), F.col("body").alias("html"))
    return S.extract_html_links(pages, "html", ["page"]).select("page", "id", "title", "date")


@query("SELECT s_nationkey AS page, CAST(2000 + s_suppkey % 30 AS INTEGER) AS year, CAST(s_suppkey % 52 + 1 AS INTEGER) AS week, 'https://r.example/' || s_suppkey AS url, 'Report ' || s_suppkey AS title FROM supplier")
def s11_weekly_reports(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    row = _text('<tr><td headers="weeks">', k % 30 + 2000, "年第", k % 52 + 1, '週</td><td headers="date">x</td><td headers="link"><a href="https://r.example/', k, '">Report ', k, "</a></td></tr>")
    pages = _listed(spark.read.parquet(f"{d}/supplier.parquet"), "s_nationkey", "s_suppkey", row).select(F.col("s_nationkey").alias("page"), F.col("body").alias("html"))
    return S.extract_weekly_reports(pages, "html", ["page"]).select("page", "year", "week", "url", "title")


@query(f"{_B} SELECT n, id AS identifier, 'Alert' AS \"msgType\", CASE WHEN n % 2 = 0 THEN 'Severe' ELSE 'Minor' END AS severity, title AS headline, region AS \"areaDesc\", CAST(NULL AS VARCHAR) AS urgency FROM b")
def s12_cap(spark: SparkSession, d: str) -> DataFrame:
    """An alert for each event, with and without a namespace prefix."""
    e = events(spark, d)
    n = F.col("n")
    p = F.when(n % 3 == 0, "cap:").otherwise("")
    tag = lambda name, body: _text("<", p, name, ">", body, "</", p, name, ">")
    info = F.concat(tag("severity", F.when(n % 2 == 0, "Severe").otherwise("Minor")), tag("headline", F.col("title")), tag("area", tag("areaDesc", F.col("region"))))
    xml = tag("alert", F.concat(tag("identifier", F.col("id")), tag("msgType", F.lit("Alert")), tag("info", info)))
    return S.parse_cap(e.select("n", xml.alias("xml")), "xml", ["n"]).select("n", "identifier", "msgType", "severity", "headline", "areaDesc", "urgency")


@query(f"{_B}, a AS (SELECT n, CASE WHEN n % 2 = 0 THEN 'https://m.example/' ELSE 'https://w.example/' END || entity AS link, title FROM b WHERE n % 7 <> 0) SELECT link, (list(title ORDER BY n))[1] AS title FROM a GROUP BY link")
def s14_articles(spark: SparkSession, d: str) -> DataFrame:
    """One list for each event's entity; every seventh address is none of the web."""
    n = F.col("n")
    url = F.concat(F.when(n % 7 == 0, "ftp://w.example/").otherwise("https://w.example/"), "entity")
    mobile = F.when((n % 2 == 0) & (n % 7 != 0), F.concat(F.lit("https://m.example/"), "entity")).otherwise("")
    one = F.to_json(F.struct(url.alias("url"), mobile.alias("url_mobile"), "title", F.lit("20240101T000000Z").alias("seendate")))
    lists = _listed(events(spark, d), "entity", "n", one, ",").select("entity", _text('{"articles":[', F.col("body"), "]}").alias("body"))
    return S.read_article_list(lists, "body", ["entity"]).select("link", "title")


@query(f"{_B}, c AS (SELECT DISTINCT dataset, CAST(substr(dataset, 3) AS INTEGER) AS k FROM b) SELECT dataset FROM c WHERE k % 3 < 2 AND (k % 2 = 0 OR k % 5 = 0)")
def s15_select_feeds(spark: SparkSession, d: str) -> DataFrame:
    k = F.substring("dataset", 3, 9).cast("int")
    catalog = events(spark, d).select("dataset").distinct().select("dataset", F.get(F.array(F.lit("core"), F.lit("expanded"), F.lit("bulk")), k % 3).alias("tier"), F.when(k % 2 == 0, "cyber").otherwise("law").alias("topic"), F.when(k % 5 == 0, F.array(F.lit("cyber"))).alias("topics"))
    return S.select_feeds(catalog, "expanded", "cyber").select("dataset")


@query(f"{_B} SELECT n, dataset, CASE WHEN n % 3 = 0 THEN 'https://u/' || n END AS url FROM b")
def s16_slim_events(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    ref = _text("https://r/", n)
    e = events(spark, d).select("n", F.array("entity").alias("aiEntities"), F.struct("dataset", ref.alias("recordRef"), F.when(n % 3 == 0, _text("https://u/", n)).otherwise(ref).alias("url"), F.lit("q").alias("query")).alias("source"))
    return S.slim_events(e).select("n", "source.dataset", "source.url")


@query(f"{_B} SELECT id, title, region, lat, lng, ts, category, risk, scope, source_name, dataset FROM b WHERE lat IS NOT NULL")
def s17_map_points(spark: SparkSession, d: str) -> DataFrame:
    return S.map_points(events(spark, d)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"{_B} SELECT n, '2024-01-20' AS generated_at FROM b WHERE dataset IN ('ds1', 'ds3')")
def s18_lookup_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return S.lookup_snapshot(events(spark, d), ("ds1", "ds3"), F.lit("2024-01-20")).select("n", "generated_at")


@query(f"{_B} SELECT n, risk, CAST(NULL AS VARCHAR) AS region FROM b WHERE n % 2 = 0 UNION ALL SELECT n, NULL, region FROM b WHERE n % 2 = 1")
def s19_union_sources(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return S.union_sources(e.where("n % 2 = 0").select("n", "risk"), e.where("n % 2 = 1").select("n", "region"))


def _landed(spark: SparkSession, e: DataFrame) -> DataFrame:
    """Rows as a stream of files that are read one at a time."""
    path = materialize(e.repartition(3, "n"), "landed").inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


_CELL = "SELECT strftime(ts, '%Y-%m-%d') AS day, '{0}' AS dim, {1} AS value, count(*) AS n FROM b WHERE {2} GROUP BY ALL"
_CELLS = " UNION ALL ".join(_CELL.format(*x) for x in (("total", "'all'", "true"), ("category", "category", "true"), ("scope", "scope", "true"), ("risk", "risk", "true")))


@query(f"{_B} {_CELLS}")
def i05_streamed_days(spark: SparkSession, d: str) -> DataFrame:
    """Daily cells kept up to date by a stream of the events in three batches."""
    store = SnapshotStore(spark, scratch_path(spark, "cells"))
    rolling.roll_daily(_landed(spark, events(spark, d).select("id", "n", "ts", "scope", "risk", "category")), store, scratch_path(spark, "checkpoint")).awaitTermination()
    return store.read("cells", rolling.CELLS)


@query(f"{_B} SELECT id, n, ts FROM b")
def i02_streamed_once(spark: SparkSession, d: str) -> DataFrame:
    """Every event of a stream once, a third of which come twice, in another file."""
    e = events(spark, d).select("id", "n", "ts")
    out = scratch_path(spark, "once")
    stream = rolling.fresh_once(_landed(spark, e.union(e.where("n % 3 = 0").selectExpr("id", "n", "ts"))), late="60 days")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(e.schema).parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


#: Slots of an hour, and hours after which a fingerprint is new again.
SLOTS, TTL = 9, 100
_STREAM = f"""{_B}, ev AS (SELECT dataset || ':' || entity AS fp, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, n FROM b), hf AS (SELECT hour, fp, count(*) AS k, min(n) AS first FROM ev GROUP BY ALL),
ar AS (SELECT hour AS came, fp, first FROM hf QUALIFY coalesce(hour - lag(hour) OVER (PARTITION BY fp ORDER BY hour) > {TTL}, true)), sp AS (SELECT min(hour) AS h0, max(hour) AS h1 FROM hf), hr AS (SELECT unnest(generate_series(h0, h1)) AS hour, h0 FROM sp),
c AS (SELECT hour, h0, coalesce((SELECT sum(k) FROM hf WHERE hf.hour = hr.hour), 0) AS fetched, (SELECT count(*) FROM hf WHERE hf.hour = hr.hour) AS uniq, (SELECT count(*) FROM ar WHERE came = hr.hour) AS arrived FROM hr),
a AS (SELECT *, sum(arrived) OVER (ORDER BY hour) AS a FROM c), s AS (SELECT *, a - arrived - {SLOTS} * (hour - h0) AS slack FROM a), q AS (SELECT *, least(a, {SLOTS} * (hour - h0 + 1) + min(slack) OVER (ORDER BY hour)) AS d FROM s), r AS (SELECT *, d - lag(d, 1, 0) OVER (ORDER BY hour) AS new FROM q)"""


def _streamed_hours(spark: SparkSession, d: str) -> SnapshotStore:
    """The events in three files, in no order of time, and one much later event that closes all their hours."""
    e = events(spark, d).select("n", F.concat_ws(":", "dataset", "entity").alias("fingerprint"), "ts")
    landed, store = scratch_path(spark, "landed"), SnapshotStore(spark, scratch_path(spark, "hours"))
    e.repartition(3, "n").write.parquet(landed)
    e.agg(F.lit(-1).cast("long").alias("n"), F.lit("end").alias("fingerprint"), F.expr("max(ts) + INTERVAL 100 DAYS").alias("ts")).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    stream_hours(stream, store, scratch_path(spark, "checkpoint"), SLOTS, TTL, "60 days").awaitTermination()
    return store


@query(f"{_STREAM} SELECT hour, CAST(fetched AS BIGINT) AS fetched, uniq AS \"unique\", arrived, CAST(new AS BIGINT) AS new, CAST(fetched - arrived AS BIGINT) AS duplicate, CAST(a - d AS BIGINT) AS deferred FROM r WHERE fetched > 0 OR new > 0 OR a > d")
def i04_batch_hours(spark: SparkSession, d: str) -> DataFrame:
    """All hours of the events at once."""
    return _batch_hours(spark, d)[0]


@query(f"{_STREAM}, p AS (SELECT *, row_number() OVER (ORDER BY came, first, fp) AS place FROM ar) SELECT hour, fp AS fingerprint, first FROM p JOIN r ON place > d - new AND place <= d")
def i04_batch_records(spark: SparkSession, d: str) -> DataFrame:
    return _batch_hours(spark, d)[1]


def _batch_hours(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    hourly = materialize(by_hour(events(spark, d).withColumn("fingerprint", F.concat_ws(":", "dataset", "entity"))), "hourly")
    return hourly_runs(hourly, SLOTS, TTL, until=hourly.agg(F.max("hour")).first()[0])


@query(f"{_STREAM} SELECT hour, CAST(fetched AS BIGINT) AS fetched, uniq AS \"unique\", arrived, CAST(new AS BIGINT) AS new, CAST(fetched - arrived AS BIGINT) AS duplicate, CAST(a - d AS BIGINT) AS deferred FROM r WHERE fetched > 0 OR new > 0 OR a > d")
def i04_streamed_hours(spark: SparkSession, d: str) -> DataFrame:
    """The same runs from a stream with a ledger and a queue, by files."""
    return _streamed_hours(spark, d).read("runs", RUNS)


@query(f"{_B} SELECT n, region, CASE WHEN day(ts) % 2 = 0 THEN 'revised' ELSE risk END AS risk, CAST(ts AS DATE) AS day FROM b")
def s05_event_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Events written by days, the even days written again, then a version that breaks off: what a reader gets."""
    path = scratch_path(spark, "events")
    store = SnapshotStore(spark, path)
    e = events(spark, d).select("n", "region", "risk", F.col("ts").cast("date").alias("day"))
    store.write({"events": e}, by_day={"events": "day"})
    store.write({"events": e.where(F.dayofmonth("day") % 2 == 0).withColumn("risk", F.lit("revised"))}, by_day={"events": "day"})
    torn = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{3:012d}.json")
    out = torn.getFileSystem(spark._jsc.hadoopConfiguration()).create(torn)
    out.write(bytearray(b'{"version": 3, "tables": {'))
    out.close()
    return store.read("events", e.schema)


@query(f"{_B} SELECT n, region, risk_rank, ts FROM b WHERE risk_rank >= 3 AND region <> 'FRANCE' AND title LIKE 'k1%'")
def s03_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Events in envelopes of a thousand rows, read by the data source with pushed filters."""
    register(spark)
    e = events(spark, d)
    cells = F.to_json(F.struct("n", "title", "region", F.col("risk_rank").cast("string").alias("risk_rank"), F.col("ts").cast("timestamp_ntz").cast("string").alias("ts"), F.lit("unused").alias("more")))
    row = F.concat(F.lit("["), F.expr("substring(r, 2, length(r) - 2)"), F.lit("]"))
    files = e.withColumn("r", F.regexp_replace(cells, r'"(?:n|title|region|risk_rank|ts|more)":', "")).groupBy(F.floor(F.col("n") / 1000).alias("file")).agg(F.array_join(F.collect_list(row), ",").alias("rows"))
    path = scratch_path(spark, "envelopes")
    files.select(F.concat(F.lit('{"columns": ["n", "title", "region", "risk_rank", "ts", "more"], "rows": ['), "rows", F.lit("]}")).alias("value")).write.text(path)
    found = spark.read.format("envelopes").schema("risk_rank int, n long, region string, ts string, title string").load(path)
    return found.where("risk_rank >= 3 and region <> 'FRANCE' and title like 'k1%'").select("n", "region", "risk_rank", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"{_B} SELECT id, category, risk, false AS broken FROM b WHERE n % 10 = 0 UNION ALL SELECT NULL, NULL, NULL, true FROM range(3)")
def s06_review_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples written as lines of JSON, with a blank line and three broken ones among them."""
    path = scratch_path(spark, "samples")
    write_samples(events(spark, d).where("n % 10 = 0"), path)
    spark.createDataFrame([("  ",), ('{"id": "cut',), ("[1]",), ("no json",)], "value string").write.mode("append").text(path)
    return read_samples(spark, path, "keep").select("id", "category", "risk", F.col("_broken").isNotNull().alias("broken"))


@query(f"{_B} SELECT n, lat, lng FROM b WHERE lat BETWEEN 22.6 AND 25.4 AND lng BETWEEN 118.6 AND 121.4")
def f15_clustered_viewport(spark: SparkSession, d: str) -> DataFrame:
    """F15, S17 on a table clustered by place: only the files that the viewport meets are read."""
    path = scratch_path(spark, "places")
    write_clustered(events(spark, d).select("n", "lat", "lng"), path, 16)
    return read_viewport(spark, path, 23, 119, 25, 121).select("n", "lat", "lng")
