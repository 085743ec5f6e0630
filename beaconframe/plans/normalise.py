"""Queries of the normalisers, on orders, line items, suppliers, parts, documents and events in the place of landed tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconframe.functions import places as P
from beaconframe.functions import rules as R
from beaconframe.operators import normalise as N
from beaconframe.plans.bindings import EVENTS_SQL, events
from beaconframe.plans.registry import Registry
from beaconframe.plans.rules import _ITEMS, HINTS, TITLES, _category_sql, _county_sql, _items, _pick, _risk_sql, _sql_pick

query = Registry()
NOW = datetime(2024, 1, 20)
_NOW = "TIMESTAMP '2024-01-20 00:00:00'"
_B = f"WITH {EVENTS_SQL}"


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


@query(
    """SELECT 'pcc-' || o_orderkey AS id, 'Order ' || o_orderkey AS title, n_name AS region, coalesce(CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END, TIMESTAMP '2024-01-20') AS ts, '採購' AS category, CASE WHEN o_totalprice >= 400000 THEN 'critical' WHEN o_totalprice >= 250000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'low' END AS risk, o_orderpriority AS summary
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority >= '2' ORDER BY o_totalprice DESC, o_orderkey LIMIT 300"""
)
def n01_tenders(spark: SparkSession, d: str) -> DataFrame:
    """N01-N03."""
    o = _read(spark, d, "orders").join(_read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(_read(spark, d, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey")
    cfg = N.Config("pcc", key, F.concat(F.lit("Order "), key.cast("string")), F.col("n_name"), F.when(key % 9 != 0, F.col("o_orderdate")), "採購", R.risk_by_price(F.col("o_totalprice"), (400_000, 250_000, 100_000)), F.col("o_orderpriority"), where=F.col("o_orderpriority") >= "2", order=[F.desc("o_totalprice"), key], limit=300)
    return N.normalize_rows(o, cfg, NOW).select("id", "title", "region", F.col("ts").cast("timestamp_ntz").alias("ts"), "category", "risk", "summary")


@query("SELECT * FROM (SELECT o_orderkey, 'open' AS label FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 100) UNION ALL SELECT * FROM (SELECT o_orderkey, 'filled' FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100)")
def n04_many(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return N.normalize_many({"open": o.where("o_orderstatus = 'O'"), "filled": o.where("o_orderstatus = 'F'")}, 100, "o_orderkey").select("o_orderkey", "label")


@query("WITH l AS (SELECT l_orderkey, l_linenumber, (l_partkey % 3) AS party, l_partkey FROM lineitem) SELECT l_orderkey, l_linenumber, party FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY party <> 1, l_linenumber) = 1")
def n05_parties(spark: SparkSession, d: str) -> DataFrame:
    l = _read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p")).select("l_orderkey", "l_linenumber", (F.col("p") % 3).alias("party"))  # noqa: E741
    return N.dedupe_parties(l, ["l_orderkey"], "party", "l_linenumber")


query.sql["n05_parties"] = "WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) % 3 AS party FROM lineitem GROUP BY 1, 2) SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY party <> 1, l_linenumber) = 1"
_MONTHS = "m AS (SELECT strftime(o_orderdate, '%Y%m') AS period, count(*) AS occurred, count(*) FILTER (o_orderstatus = 'F') AS cleared FROM orders GROUP BY 1)"


@query(f"WITH {_MONTHS} SELECT period, occurred, cleared FROM m ORDER BY period DESC LIMIT 1")
def n06_latest_pair(spark: SparkSession, d: str) -> DataFrame:
    by = _read(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyyMM").alias("period")).agg(F.count("*").alias("occurred"), F.count_if(F.col("o_orderstatus") == "F").alias("cleared"))
    return N.latest_period_join(by, by, "period", "occurred", "cleared")


@query("WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, * FROM orders) SELECT day, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS filled, CAST(sum(o_custkey) AS BIGINT) AS customers FROM o WHERE day = (SELECT max(day) FROM o) GROUP BY day")
def n07_latest_sums(spark: SparkSession, d: str) -> DataFrame:
    """N07, N24."""
    o = _read(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return N.latest_partition_sums(o, "day", {"total": F.lit(1).cast("long"), "filled": (F.col("o_orderstatus") == "F").cast("long"), "customers": F.col("o_custkey")})


@query("WITH g AS (SELECT l_returnflag || l_linestatus AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1) SELECT CAST(sum(v) AS BIGINT) AS total, string_agg(k || ' ' || v, '、' ORDER BY v DESC, k) AS breakdown FROM g")
def n08_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return N.group_breakdown(_read(spark, d, "lineitem").withColumn("k", F.concat("l_returnflag", "l_linestatus")), "k", F.col("l_quantity").cast("long"))


@query("WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS period FROM orders) SELECT * FROM o WHERE period = (SELECT max(period) FROM o)")
def n09_latest_rows(spark: SparkSession, d: str) -> DataFrame:
    return N.latest_period_rows(_read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("period")), "period").select("o_orderkey", "period")


@query("WITH c AS (SELECT o_orderpriority AS label, month(o_orderdate) AS m, count(*) AS k FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) <> 2 GROUP BY ALL) SELECT label, CAST(sum(k) AS DOUBLE) AS total, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS months FROM c GROUP BY label")
def n10_months(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders").where("year(o_orderdate) = 1996 and month(o_orderdate) <> 2")
    wide = o.withColumn("m", F.month("o_orderdate")).groupBy(F.col("o_orderpriority").alias("label")).pivot("m", list(range(1, 13))).count()
    return N.unpivot_months(wide, "label", [str(i) for i in range(1, 13)]).withColumn("months", F.array_join(F.col("months").cast("array<string>"), ","))


@query("SELECT unnest(['n', 'quantity']) AS metric, unnest([CAST(count(*) AS DOUBLE), CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)]) AS value FROM lineitem")
def n11_metrics(spark: SparkSession, d: str) -> DataFrame:
    by = _read(spark, d, "lineitem").rollup("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.grouping("l_returnflag").alias("total"))
    return N.metrics_from_total_row(by, F.col("total") == 1, ["n", "quantity"])


@query("WITH g AS (SELECT p_brand AS kind, CAST(sum(p_size) AS BIGINT) AS n FROM part GROUP BY 1), r AS (SELECT kind, n, CASE WHEN n >= 100 THEN 'high' WHEN n >= 30 THEN 'medium' ELSE 'low' END AS risk FROM g WHERE n > 0) SELECT * FROM r UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), CASE max(CASE risk WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END FROM r")
def n12_weekly_counts(spark: SparkSession, d: str) -> DataFrame:
    return N.weekly_counts_events(_read(spark, d, "part"), "p_brand", "p_size")


@query("WITH g AS (SELECT isoyear(l_shipdate) AS y, weekofyear(l_shipdate) AS k, count(*) AS total FROM lineitem GROUP BY 1, 2), r AS (SELECT y * 100 + k AS week, total, lag(total) OVER (ORDER BY y * 100 + k) AS previous, y, k FROM g) SELECT week, total, previous, CASE WHEN previous > 0 THEN round(100.0 * (total - previous) / previous, 1) END AS change, CAST(date_trunc('week', make_date(y, 1, 4)) AS DATE) + CAST((k - 1) * 7 + 6 AS INTEGER) AS week_end, CASE WHEN total >= 50 THEN 'high' WHEN total >= 20 THEN 'medium' ELSE 'low' END AS risk FROM r ORDER BY week DESC LIMIT 1")
def n13_week_over_week(spark: SparkSession, d: str) -> DataFrame:
    """N13, W08."""
    l = _read(spark, d, "lineitem").select(F.extract(F.lit("YEAROFWEEK"), F.col("l_shipdate")).alias("y"), F.weekofyear("l_shipdate").alias("k"), F.lit(1).cast("long").alias("v"))  # noqa: E741
    return N.week_over_week(l, "y", "k", "v").withColumn("week", F.col("week").cast("long"))


@query(f"{_B} SELECT n, 'tfda-' || substr(sha1(title || n), 1, 16) AS id FROM b WHERE ts BETWEEN {_NOW} - INTERVAL 3 DAY AND {_NOW} ORDER BY ts DESC, n LIMIT 50")
def n14_recent(spark: SparkSession, d: str) -> DataFrame:
    return N.recent_topn(events(spark, d), NOW, 3, 50, "tfda", F.concat("title", F.col("n").cast("string"))).select("n", "id")


@query(f"{_B} SELECT n, CAST(n % 40 AS INTEGER) AS aircraft, CAST(n % 13 AS INTEGER) AS ships, CASE WHEN n % 40 >= 30 THEN 'high' WHEN greatest(n % 40, n % 13) >= 10 THEN 'medium' ELSE 'low' END AS risk FROM b")
def n15_counts_in_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("共機 "), (F.col("n") % 40).cast("string"), F.lit(" 架次、共艦 "), (F.col("n") % 13).cast("string"), F.lit(" 艘"))
    c = N.extract_counts(text, {"aircraft": r"(\d+)\s*架次", "ships": r"(\d+)\s*艘"})
    return events(spark, d).withColumn("c", c).select("n", "c.aircraft", "c.ships", "c.risk")


@query(f"{_B} SELECT (SELECT category FROM b WHERE n % 3 = 0 ORDER BY n DESC LIMIT 1) AS load, (SELECT region FROM b WHERE n % 7 = 1 ORDER BY n DESC LIMIT 1) AS reserve")
def n16_merge_records(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("n", F.when(F.col("n") % 3 == 0, F.col("category")).alias("load"), F.when(F.col("n") % 7 == 1, F.col("region")).alias("reserve"))
    return N.merge_records(e, ["load", "reserve"], "n")


@query("WITH s AS (SELECT s_suppkey, s_nationkey, round(abs(s_acctbal) / 100, 2) AS rate FROM supplier WHERE s_suppkey % 5 <> 0 ORDER BY rate, s_suppkey LIMIT 20) SELECT s_suppkey, rate, n_name AS region, CASE WHEN rate <= 20 THEN 'high' WHEN rate <= 40 THEN 'medium' ELSE 'low' END AS risk FROM s LEFT JOIN nation ON n_nationkey = s_nationkey")
def n17_reservoirs(spark: SparkSession, d: str) -> DataFrame:
    s = _read(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.round(F.abs("s_acctbal") / 100, 2).alias("rate"))
    dim = _read(spark, d, "supplier").join(_read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("region"))
    return N.lowest_n_with_dim(s, dim, "s_suppkey", "rate", 20, F.col("s_suppkey") % 5 == 0).select("s_suppkey", "rate", "region", "risk")


_OBS = """o AS (SELECT l_suppkey AS station, l_linenumber % 4 <> 0 AS ok, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS level, l_shipdate AS ts FROM lineitem), st AS (SELECT s_suppkey AS station, s_name AS name, CASE WHEN s_suppkey % 6 <> 0 THEN n_name END AS region, CASE WHEN s_suppkey % 2 = 0 THEN 48.0 END AS a1, 44.0 AS a2, 42.0 AS a3 FROM supplier JOIN nation ON n_nationkey = s_nationkey),
j AS (SELECT *, CASE WHEN level >= a1 THEN 2 WHEN level >= a2 OR level >= a3 THEN 1 ELSE 0 END AS rank FROM o JOIN st USING (station) WHERE ok AND level IS NOT NULL AND region IS NOT NULL)"""


@query(f"WITH {_OBS} SELECT region, count(*) AS n, count(*) FILTER (rank > 0) AS alerts, array_to_string((list_sort(list(DISTINCT name) FILTER (rank > 0)))[1:3], ',') AS names, max(rank) AS rank, max(ts) AS ts FROM j GROUP BY region")
def n18_station_alerts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    stations = _read(spark, d, "supplier").join(F.broadcast(_read(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey")).select(k.alias("station"), F.col("s_name").alias("name"), F.when(k % 6 != 0, F.col("n_name")).alias("region"), F.when(k % 2 == 0, "48").otherwise(" ").alias("first"), F.lit("44").alias("second"), F.lit("42").alias("third"))
    obs = _read(spark, d, "lineitem").select(F.col("l_suppkey").alias("station"), (F.col("l_linenumber") % 4 != 0).alias("ok"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("level"), F.col("l_shipdate").alias("ts"))
    return N.station_alerts(obs, stations).withColumn("names", F.array_join("names", ","))


query.sql["n18_station_alerts"] = query.sql["n18_station_alerts"].replace("array_to_string((list_sort(list(DISTINCT name) FILTER (rank > 0)))[1:3], ',')", "coalesce(array_to_string((list_sort(list(DISTINCT name) FILTER (rank > 0)))[1:3], ','), '')")


@query("WITH l AS (SELECT l_suppkey AS site, l_returnflag AS item, l_linenumber AS h, max(l_quantity) AS v FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL), m AS (SELECT site, item, max(h) AS h, arg_max(v, h) AS v FROM l GROUP BY ALL) SELECT site, string_agg(item || '=' || CAST(v AS BIGINT), ',' ORDER BY item) AS metrics, CAST(max(h) - 1 AS INTEGER) AS hour, CAST(site % 7 AS DOUBLE) AS lat FROM m GROUP BY site")
def n19_latest_hours(spark: SparkSession, d: str) -> DataFrame:
    wide = _read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("site"), F.col("l_returnflag").alias("item")).pivot("l_linenumber", [1, 2, 3, 4]).agg(F.max("l_quantity"))
    stations = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), (F.col("s_suppkey") % 7).cast("double").alias("lat"), F.lit(0.0).alias("lng"))
    out = N.latest_hour_unpivot(wide, "site", "item", ["1", "2", "3", "4"], stations)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("metrics")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("long").cast("string"))), ",")
    return out.select("site", text.alias("metrics"), "hour", "lat")


@query("WITH s AS (SELECT CAST(sum(p_size) AS BIGINT) AS total, CAST(sum(greatest(0, least(CAST(p_partkey % 9 AS INTEGER) - 1, p_size))) AS BIGINT) AS free, max(p_partkey) AS at_key FROM part WHERE p_size > 0) SELECT total, free, at_key, round(free / total, 4) AS ratio, CASE WHEN round(free / total, 4) <= 0.05 THEN 'high' WHEN round(free / total, 4) <= 0.1 THEN 'medium' ELSE 'low' END AS risk FROM s")
def n20_supply_ratio(spark: SparkSession, d: str) -> DataFrame:
    return N.supply_ratio(_read(spark, d, "part").select("p_size", ((F.col("p_partkey") % 9) - 1).alias("f"), "p_partkey"), "p_size", "f", "p_partkey").withColumnRenamed("at", "at_key")


@query(f"WITH {_MONTHS} SELECT period, CAST(occurred AS DOUBLE) AS occurred, CAST(cleared AS DOUBLE) AS cleared FROM m ORDER BY period DESC LIMIT 1")
def n21_indicator(spark: SparkSession, d: str) -> DataFrame:
    by = _read(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyyMM").alias("period")).agg(F.count("*").cast("string").alias("occurred"), F.count_if(F.col("o_orderstatus") == "F").cast("string").alias("cleared"))
    return N.latest_indicator(by.union(by.limit(1).select(F.lit("總計").alias("period"), "occurred", "cleared")), "period", ["occurred", "cleared"])


@query("WITH l AS (SELECT CAST(l_shipdate AS DATE) AS day, l_partkey, min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem GROUP BY 1, 2) SELECT l_partkey, o FROM l WHERE day = (SELECT max(day) FROM l) ORDER BY o LIMIT 8")
def n22_price_sample(spark: SparkSession, d: str) -> DataFrame:
    l = _read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))  # noqa: E741
    return N.latest_distinct_sample(l, "day", "l_partkey", "o").select("l_partkey", "o")


@query("SELECT 'parts' AS name, count(*) AS n FROM part")
def n23_count(spark: SparkSession, d: str) -> DataFrame:
    return N.count_snapshot(_read(spark, d, "part"), "parts")


@query("WITH t AS (SELECT l_returnflag || '/' || l_linestatus AS s, count(*) AS k FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) SELECT (SELECT max(l_shipdate) FROM lineitem) AS latest, (SELECT count(*) FROM lineitem) AS n, string_agg(s || ' ' || k, '、' ORDER BY k DESC, s) AS statuses FROM t")
def n25_statuses(spark: SparkSession, d: str) -> DataFrame:
    l = _read(spark, d, "lineitem").select("l_shipdate", F.date_sub("l_shipdate", 3).cast("timestamp_ntz").alias("earlier"), F.concat("l_returnflag", F.lit("/"), "l_linestatus").alias("s"))  # noqa: E741
    return N.status_topk(l, ["l_shipdate", "earlier"], "s")


@query("WITH g AS (SELECT p_brand AS k, CAST(sum(p_size) AS BIGINT) AS v FROM part WHERE p_size IS NOT NULL GROUP BY 1) SELECT CAST(sum(v) AS BIGINT) AS total, string_agg(k || ' ' || v, '；' ORDER BY k) AS items FROM g")
def n26_sum_and_list(spark: SparkSession, d: str) -> DataFrame:
    return N.sum_and_list(_read(spark, d, "part"), "p_brand", "p_size")


@query("SELECT CAST(sum(l_linenumber + 1 + CAST(l_quantity AS BIGINT)) AS BIGINT) AS people, count(DISTINCT l_suppkey) AS districts, count(DISTINCT (l_suppkey, l_partkey)) AS villages FROM lineitem WHERE l_returnflag = 'A'")
def n27_population(spark: SparkSession, d: str) -> DataFrame:
    l = _read(spark, d, "lineitem").select("l_returnflag", "l_linenumber", F.lit(1).alias("one"), F.col("l_quantity").cast("long").alias("q"), "l_suppkey", "l_partkey")  # noqa: E741
    return N.population_totals(l, "l_returnflag", ["l_linenumber", "one", "q"], "l_suppkey", "l_partkey", "A")


@query("SELECT year(o_orderdate) AS y, CAST(sum(o_custkey) AS BIGINT) AS customers FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) GROUP BY 1")
def n28_latest_year(spark: SparkSession, d: str) -> DataFrame:
    """The total row of a rollup comes before the sum of the others."""
    by = _read(spark, d, "orders").withColumn("y", F.year("o_orderdate").cast("long")).groupBy("y", "o_orderpriority").agg(F.sum("o_custkey").alias("customers"))
    total = by.groupBy("y").agg(F.lit("total").alias("o_orderpriority"), F.sum("customers").alias("customers"))
    return N.latest_year(by.unionByName(total), "y", F.col("o_orderpriority") == "total", ["customers"])


@query("WITH l AS (SELECT CAST(l_shipdate AS DATE) AS day, l_partkey, CAST(l_quantity AS BIGINT) - 25 AS net FROM lineitem) SELECT day, CAST(sum(net) AS BIGINT) AS net, count(DISTINCT l_partkey) AS products FROM l WHERE day = (SELECT max(day) FROM l) GROUP BY day")
def n29_latest_net(spark: SparkSession, d: str) -> DataFrame:
    return N.latest_day_net(_read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), "l_partkey", (F.col("l_quantity").cast("long") - 25).alias("net")), "day", "net", "l_partkey")


_SKY = ("豪雨", "超大豪雨", "大雨", "", "多雲")


@query(f"{_B}, h AS (SELECT n, unnest(CASE WHEN n % 4 = 0 THEN [] ELSE [{_sql_pick(_SKY, 'n')}, {_sql_pick(_SKY, 'n + 2')}] END) AS phenomena FROM b) SELECT n, phenomena, CASE phenomena WHEN '超大豪雨' THEN 'critical' WHEN '豪雨' THEN 'high' WHEN '大雨' THEN 'medium' ELSE 'low' END AS risk FROM h WHERE phenomena <> ''")
def n30_warnings(spark: SparkSession, d: str) -> DataFrame:
    one = lambda i: F.struct(_pick(_SKY, F.col("n") + i).alias("phenomena"), F.lit("警").alias("significance"), F.col("ts").alias("start"), F.col("ts").alias("end"))
    e = events(spark, d).withColumn("hazards", F.when(F.col("n") % 4 != 0, F.array(one(0), one(2)))).select("n", "hazards")
    return N.explode_warnings(e, "hazards").select("n", "phenomena", "risk")


@query(f"{_B} SELECT n, CASE WHEN n % 3 = 0 THEN '花蓮縣' ELSE '海域' END AS region, CASE WHEN n % 8 >= 6 THEN 'critical' WHEN n % 8 >= 5 THEN 'high' WHEN n % 8 >= 4 THEN 'medium' ELSE 'low' END AS risk, CAST(n AS VARCHAR) AS report FROM b")
def n31_quakes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    e = events(spark, d).select("n", F.when(n % 3 == 0, "花蓮縣政府南方").otherwise("臺灣東部海域").alias("place"), F.concat(F.lit("https://x/EQ"), n.cast("string"), F.lit(".html")).alias("web"))
    return e.select("n", N.quake_region(F.col("place")).alias("region"), R.risk_by_magnitude((n % 8).cast("double")).alias("risk"), F.regexp_extract("web", r"EQ(\d+)\.", 1).alias("report"))


_ALERTS = f"{_B}, e AS (SELECT id AS href, category, CASE WHEN n % 9 = 0 THEN 'Cancel' ELSE 'Alert' END AS kind, ts AS updated, CASE WHEN n % 5 <> 0 THEN ts + INTERVAL 6 DAY END AS expires FROM b WHERE ts <= {_NOW}), l AS (SELECT * FROM e WHERE category IN ('click', 'view') AND kind <> 'Cancel' AND (expires IS NULL OR expires >= {_NOW})), t AS (SELECT * FROM l ORDER BY updated DESC, href LIMIT 60), k AS (SELECT t.href, CASE t.category WHEN 'click' THEN '交通' ELSE '災防' END AS category, CASE n % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'low' END AS risk FROM t JOIN b ON b.id = t.href WHERE n % 7 <> 0 OR n % 2 = 0)"


def _alerts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("n")
    e = events(spark, d).where(F.col("ts") <= F.lit(NOW))
    entries = e.select(F.col("id").alias("href"), "category", F.when(n % 9 == 0, "Cancel").otherwise("Alert").alias("kind"), F.col("ts").alias("updated"), F.when(n % 5 != 0, F.col("ts") + F.expr("INTERVAL 6 DAYS")).alias("expires"))
    details = e.select(F.col("id").alias("href"), _pick(("Extreme", "Severe", "?"), n).alias("severity"), F.when((n % 7 == 0) & (n % 2 != 0), F.lit(datetime(2024, 1, 1))).alias("expires"))
    return N.select_alerts(entries, details, NOW, {"click": "交通", "view": "災防"})


@query(f"{_ALERTS} SELECT * FROM k")
def n32_alerts(spark: SparkSession, d: str) -> DataFrame:
    return _alerts(spark, d)[0].select("href", "category", "risk")


@query(f"{_ALERTS} SELECT (SELECT count(*) FROM e) AS entries, (SELECT count(*) FROM e WHERE category IN ('click', 'view')) AS known, (SELECT count(*) FROM l) AS live, (SELECT count(*) FROM k) AS kept")
def n32_funnel(spark: SparkSession, d: str) -> DataFrame:
    return _alerts(spark, d)[1]


_CHARGE = ("殺人", "詐欺", "竊盜")


@query(f"{_B}, f AS (SELECT entity AS jid, min(n) AS n FROM b GROUP BY 1) SELECT jid, CASE WHEN n % 4 = 0 THEN '臺北市' WHEN n % 4 = 1 THEN '高雄市' END AS city, CASE WHEN n % 3 = 0 THEN 'critical' WHEN n % 5 = 0 OR n % 2 = 0 THEN 'high' ELSE 'low' END AS risk FROM f")
def n33_rulings(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    r = events(spark, d).select("n", F.col("entity").alias("jid"), _pick(("TPDX", "KSDX", "ZZZX", "YYYX"), n).alias("court"), _pick(_CHARGE, n).alias("title"), F.when(n % 5 == 0, "有期徒刑").otherwise("").alias("sentence"), F.when(n % 2 == 0, "有罪").otherwise("無罪").alias("outcome"), F.col("ts").alias("date"))
    return N.normalize_rulings(r, spark.createDataFrame([("TPD", "臺北市"), ("KSD", "高雄市")], "prefix string, city string")).select("jid", "city", "risk")


@query(f"{_B}, p AS (SELECT n, CASE WHEN n % 4 <> 0 THEN 't' || (n // 3) ELSE 'p' || (n % 50) || '|' || strftime(ts, '%Y-%m-%d') END AS key, 1890 + n % 150 AS born FROM b), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY n) = 1) SELECT key, CAST(CASE WHEN born BETWEEN 1900 AND 2024 THEN 2024 - born END AS INTEGER) AS age, CASE WHEN born BETWEEN 1900 AND 2024 AND (2024 - born < 18 OR 2024 - born >= 65) THEN 'high' ELSE 'medium' END AS risk FROM f")
def n34_missing(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    p = events(spark, d).select("n", F.concat(F.lit("p"), (n % 50).cast("string")).alias("name"), (1890 + n % 150).cast("string").alias("born"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.when(n % 4 != 0, F.concat(F.lit("https://x?token=t"), F.floor(n / 3).cast("string"), F.lit("&a=1"))).alias("picture"))
    return N.normalize_missing(p.where("n % 2 = 0"), p.where("n % 2 = 1"), year=2024).select("key", "age", "risk")


_WORDS = ("紅色警示", "第三級", "黃色", "灰色", "無")


@query(f"{_B} SELECT n, region, ['critical', 'high', 'low', 'low', 'low'][n % 5 + 1] AS risk FROM b")
def n35_travel(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("n", F.concat("region", F.lit(" - "), _pick(_WORDS, F.col("n")), F.lit(" - x")).alias("title"))
    return N.normalize_travel_warnings(e).select("n", "region", "risk")


query.sql["n35_travel"] = query.sql["n35_travel"].replace("['critical', 'high', 'low', 'low', 'low'][n % 5 + 1]", "['critical', 'high', 'medium', 'low', 'low'][n % 5 + 1]")


@query(f"WITH {_ITEMS}, x AS (SELECT *, title || ' ' || description AS s, lower(regexp_replace(title, '[^\\x{{4E00}}-\\x{{9FFF}}A-Za-z0-9]', '', 'g')) AS key FROM (SELECT doc_id, title || ' 其' || doc_id % 40 AS title, hint, description FROM i)), f AS (SELECT * FROM x WHERE doc_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1) SELECT key, string_split({_category_sql()}, '|')[1] AS category, {_risk_sql()} AS risk, {_county_sql('title')} AS region FROM f WHERE key NOT IN (SELECT key FROM x WHERE doc_id % 10 = 0)")
def n36_news(spark: SparkSession, d: str) -> DataFrame:
    i = _items(spark, d).withColumn("title", F.concat("title", F.lit(" 其"), (F.col("doc_id") % 40).cast("string"))).withColumnRenamed("doc_id", "n")
    from beaconframe.functions.text import title_key

    exclude = i.where("n % 10 = 0").select(title_key(F.col("title")).alias("key"))
    t, hint, about = F.col("title"), F.col("hint"), F.col("description")
    return N.normalize_news(i, F.col("n") % 5 != 0, R.categorize(t, hint)["category"], R.rate_risk(t, hint, about), P.detect_county(t)["region"], exclude).select("key", "category", "risk", "region")


_OFFICIAL = f"""e AS (SELECT entity, {", ".join(f"first({c} ORDER BY title, risk, n) AS e_{c}" for c in ("title", "risk", "category", "region", "ts", "scope", "source_name"))}, true AS met FROM b WHERE n % 3 = 0 GROUP BY entity),
w AS (SELECT *, {_sql_pick(TITLES, "n")} AS description, {_sql_pick(HINTS + N.OFFICIAL_CATEGORIES[1:], "n // 21")} AS given FROM b WHERE authority = 'official'),
i AS (SELECT *, title || ' ' || description AS s, CASE WHEN given IN {N.OFFICIAL_CATEGORIES} THEN given ELSE '治安' END AS hint FROM w)"""


@query(
    f"""{_B}, {_OFFICIAL} SELECT entity AS link, coalesce(e_title, title) AS title, n, CASE WHEN met THEN e_risk ELSE {_risk_sql()} END AS risk, hint AS category, CASE WHEN met THEN e_category ELSE description END AS summary, CASE WHEN met THEN e_region ELSE '國際' END AS region, CASE WHEN met THEN e_ts ELSE ts END AS ts,
CASE WHEN met THEN e_scope ELSE 'international' END AS scope, coalesce(e_source_name, source_name) AS source, source_name AS feed, 'official' AS authority, 'official-feed-hint' AS basis, CASE WHEN met IS NULL THEN 'official-police-fallback' END AS method, met IS NULL AS fallback FROM i LEFT JOIN e USING (entity)"""
)
def n37_official(spark: SparkSession, d: str) -> DataFrame:
    """The official events as items, with titles and hints dealt to them as in C01; those of every third number are enriched."""
    e, n = events(spark, d).withColumnsRenamed({"entity": "link", "source_name": "source"}), F.col("n")
    items = e.where("authority = 'official'").select("link", "n", "title", "source", "ts", _pick(TITLES, n).alias("description"), _pick(HINTS + N.OFFICIAL_CATEGORIES[1:], F.floor(n / 21)).alias("hint"))
    out = N.official_fallback(items, e.where("n % 3 = 0").select("link", "n", "title", "risk", "region", "ts", "scope", "source", F.col("category").alias("summary")))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
