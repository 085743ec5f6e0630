"""Queries of filters, orders, selection and set operations on the events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconframe.functions import vocabulary as V
from beaconframe.operators import filters, selection
from beaconframe.plans.bindings import EVENTS_SQL, events
from beaconframe.plans.registry import Registry
from beaconframe.plans.rules import _pick, _re, _sql_pick

query = Registry()
NOW = datetime(2024, 1, 20)
_NOW = "TIMESTAMP '2024-01-20 00:00:00'"
_B = f"WITH {EVENTS_SQL}"

NEWS = (
    "劇透 第3集", "新劇開拍 演員", "新劇開拍 毒品查獲", "線上看", "線上看 詐騙落網", "清冊 資料查詢", "空氣品質 AQI", "反詐宣導", "反詐宣導 查獲", "藍綠互批 選舉", "市長 喊話", "市長 喊話 涉嫌",
    "美國野火 10人死", "美國野火 台灣捐款", "日本強震", "日本 資安 漏洞", "竊盜案", "食安 下架", "police arrest two", "天氣晴朗", "疫情群聚",
)
HINTS = ("", "食安", "衛生", "治安")
_NEWS = f"t AS (SELECT n, ts, {_sql_pick(NEWS, 'n')} AS title, CASE WHEN n % 50 = 0 THEN 'IQAir' WHEN n % 9 = 0 THEN '移民署' ELSE source_name END AS src, {_sql_pick(HINTS, 'n // 21')} AS hint, CASE WHEN n % 8 = 0 THEN '親子活動' ELSE '' END AS d FROM b)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    source = F.when(n % 50 == 0, "IQAir").when(n % 9 == 0, "移民署").otherwise(F.col("source_name"))
    return events(spark, d).select("n", "ts", _pick(NEWS, n).alias("title"), source.alias("src"), _pick(HINTS, F.floor(n / 21)).alias("hint"), F.when(n % 8 == 0, "親子活動").otherwise("").alias("d"))


def _plain(pattern: str) -> str:
    """The pattern without lookaround, as the words in NEWS need it."""
    import re

    return re.sub(r"\(\?<?[!=][^)]*\)", "", pattern)


_NOISE = f"({_re('title', V.ENTERTAINMENT)} OR ({_re('title', V.PRODUCTION)} AND NOT {_re('title', V.EVENT_ACTION)}) OR {_re('title', V.CONTROL_SYSTEM)} OR (NOT {_re('title', V.EVENT_ACTION)} AND ({_re('title', V.WEAK_ENTERTAINMENT)} OR {_re('title', V.LANDING_PAGE)} OR src = 'IQAir' OR {_re('title', V.AIR_REFERENCE)})))"
_OUTREACH = f"(({_re('s', V.OUTREACH)} AND NOT {_re('s', V.CRIMINAL_PROCEEDING)}) OR ({_re('src', V.IMMIGRATION_SOURCE)} AND {_re('s', V.IMMIGRATION_LIFESTYLE)} AND NOT {_re('s', V.IMMIGRATION_ENFORCEMENT)}) OR (({_re('title', V.PURE_POLITICS)} OR ({_re('title', _plain(V.POLITICAL_CONTEXT))} AND {_re('title', V.POLITICAL_RHETORIC)})) AND NOT {_re('title', V.CRIMINAL_PROCEEDING)}))"
_FOREIGN = f"(NOT {_re('s', V.CYBER_EXEMPT)} AND {_re('title', _plain(V.FOREIGN_PLACE))} AND {_re('title', V.FOREIGN_CONTEXT)} AND NOT {_re('s', V.HOME_MARKER)})"
_TOPIC = "CASE " + " ".join(f"WHEN hint = '{h}' THEN {_re('s', p)}" for h, p in V.TOPICS.items()) + f" ELSE {_re('s', V.POLICE)} OR {_re('s', V.POLICE_EN)} END"


@query(f"{_B}, {_NEWS}, x AS (SELECT *, title || ' ' || d AS s FROM t), y AS (SELECT n, {_NOISE} AS noise, {_OUTREACH} AS outreach, {_FOREIGN} AS foreign_only, {_TOPIC} AS topic FROM x) SELECT n, noise, outreach, foreign_only, NOT noise AND NOT outreach AND NOT foreign_only AND topic AS relevant FROM y")
def f02_noise_and_relevance(spark: SparkSession, d: str) -> DataFrame:
    """F02-F05 on items made of the events."""
    t, about, src, hint = F.col("title"), F.col("d"), F.col("src"), F.col("hint")
    return _items(spark, d).select(
        "n", filters.is_non_event_noise(t, src).alias("noise"), filters.is_outreach_noise(t, about, src).alias("outreach"), filters.is_foreign_only(t, about).alias("foreign_only"), filters.is_relevant(t, about, src, hint).alias("relevant")
    )


@query(f"{_B} SELECT n, dataset IN ('ds1', 'ds2') AS reference, dataset NOT IN ('ds1', 'ds2') AS news_like, lat IS NOT NULL AS displayable, risk IN ('high', 'critical') AS elevated, coalesce(lat BETWEEN 22.6 AND 25.4 AND lng BETWEEN 118.6 AND 121.4, false) AS in_view FROM b")
def f06_flags(spark: SparkSession, d: str) -> DataFrame:
    """F06, F07, F11, F13, F15 on the events."""
    lists = ("ds1", "ds2")
    return events(spark, d).select(
        "n", filters.is_reference(F.col("dataset"), lists).alias("reference"), filters.is_news_like(F.col("dataset"), lists).alias("news_like"), filters.is_displayable(F.col("lat"), F.col("lng")).alias("displayable"),
        filters.is_elevated(F.col("risk")).alias("elevated"), filters.in_viewport(F.col("lat"), F.col("lng"), 23, 119, 25, 121).alias("in_view"),
    )


@query(f"{_B} SELECT n FROM b WHERE dataset = 'ds3' OR category = 'view' OR id LIKE 'ev-9%'")
def f08_domain_events(spark: SparkSession, d: str) -> DataFrame:
    members = spark.createDataFrame([("dataset", "ds3"), ("category", "view"), ("prefix", "ev-9")], "kind string, value string")
    return filters.domain_events(events(spark, d), members).select("n")


_BROKEN = "CASE WHEN n % 17 = 0 THEN '' ELSE title END AS title, CASE WHEN n % 19 = 0 THEN 'lunar' ELSE scope END AS scope, CASE WHEN n % 23 = 0 THEN NULL ELSE risk END AS risk"


@query(f"{_B}, x AS (SELECT id, region, category, {_BROKEN} FROM b), r AS (SELECT id, CASE WHEN title = '' THEN '缺 title' WHEN scope = 'lunar' THEN 'scope 非法:lunar' WHEN risk IS NULL THEN '缺 riskLevel' END AS reason FROM x) SELECT id, reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT 'valid', CAST(count(*) AS VARCHAR) FROM r WHERE reason IS NULL")
def f09_contract(spark: SparkSession, d: str) -> DataFrame:
    """The events that break the contract once every 17th, 19th and 23rd is spoilt, and how many do not."""
    n = F.col("n")
    e = events(spark, d).withColumns({"title": F.when(n % 17 == 0, "").otherwise(F.col("title")), "scope": F.when(n % 19 == 0, "lunar").otherwise(F.col("scope")), "risk": F.when(n % 23 != 0, F.col("risk"))})
    valid, invalid = filters.validate_contract(e, {"id": "id", "title": "title", "region": "region", "timestamp": "ts", "category": "category", "scope": "scope", "riskLevel": "risk"})
    return invalid.union(valid.agg(F.lit("valid").alias("id"), F.count("*").cast("string").alias("reason")))


@query(f"{_B} SELECT n FROM b WHERE epoch_us({_NOW}) - epoch_us(ts) <= 86400000000 * CASE WHEN n % 10 = 0 THEN 15 ELSE 5 END")
def f10_retain(spark: SparkSession, d: str) -> DataFrame:
    return filters.retain(events(spark, d), NOW, 5, F.when(F.col("n") % 10 == 0, "advisory"), {"advisory": 15}).select("n")


@query(f"{_B} SELECT n FROM b WHERE source_name IN (SELECT source_name FROM b WHERE authority = 'official' GROUP BY 1 HAVING count(*) > 10)")
def f12_priority(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    feeds = e.where("authority = 'official'").groupBy(F.col("source_name").alias("label")).count().where("count > 10")
    return filters.priority_items(e, feeds, "source_name").select("n")


@query(f"{_B}, r AS (SELECT n, risk_rank >= 2 AS accepted, row_number() OVER (PARTITION BY risk_rank >= 2 ORDER BY ts DESC, n) AS pick, count(*) OVER (PARTITION BY risk_rank >= 2) AS population FROM b WHERE ts BETWEEN {_NOW} - INTERVAL 24 HOUR AND {_NOW}) SELECT n, accepted, CAST(pick AS INTEGER) AS pick, population FROM r WHERE pick <= 20")
def f14_relevance_audit(spark: SparkSession, d: str) -> DataFrame:
    return filters.relevance_audit(events(spark, d), F.col("risk_rank") >= 2, NOW).select("n", "accepted", "pick", "population")


@query(f"{_B}, e AS (SELECT * FROM b WHERE risk_rank >= 3), t AS (SELECT n, n % 7 <> 0 AS unread FROM e ORDER BY risk_rank DESC, ts DESC, n LIMIT 30) SELECT n, unread, (SELECT count(*) FROM e WHERE n % 7 <> 0) AS unread_total, (SELECT count(*) FROM e) AS total, (SELECT greatest(0, count(*) - 30) FROM e) AS capped FROM t")
def t04_triage(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return selection.triage(e, e.where("n % 7 = 0")).select("n", "unread", "unread_total", "total", "capped")


@query(f"{_B}, t AS (SELECT region, category, risk_rank, ts, n FROM b WHERE risk_rank >= 2 ORDER BY risk_rank DESC, ts DESC, n LIMIT 6), l AS (SELECT list(region ORDER BY risk_rank DESC, ts DESC, n) AS r, list(category ORDER BY risk_rank DESC, ts DESC, n) AS c FROM t) SELECT CAST(len(r) AS INTEGER) AS n, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i)[1:3], ',') AS domains, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i)[1:2], ',') AS advices FROM l")
def t07_decision_brief(spark: SparkSession, d: str) -> DataFrame:
    return selection.decision_brief(events(spark, d), "region", "category").select("n", F.array_join("domains", ",").alias("domains"), F.array_join("advices", ",").alias("advices"))


@query(f"{_B} SELECT n FROM b ORDER BY ts DESC, n LIMIT 500")
def t09_newest(spark: SparkSession, d: str) -> DataFrame:
    return selection.newest(events(spark, d)).select("n")


@query(f"{_B} SELECT n FROM b WHERE risk_rank >= 3 AND n % 2 = 1 ORDER BY n LIMIT 5")
def t10_deep_candidates(spark: SparkSession, d: str) -> DataFrame:
    return selection.deep_candidates(events(spark, d), F.col("n") % 2 == 0).select("n")


@query(f"{_B} SELECT n, risk_rank, CAST(row_number() OVER (ORDER BY risk_rank DESC, ts DESC, n) AS INTEGER) AS place FROM b WHERE dataset = 'ds4'")
def t01_risk_time(spark: SparkSession, d: str) -> DataFrame:
    """The order within one dataset, as places."""
    from pyspark.sql import Window

    return events(spark, d).where("dataset = 'ds4'").select("n", "risk_rank", F.row_number().over(Window.partitionBy("dataset").orderBy(*selection.by_risk_time())).alias("place"))


@query(f"{_B} SELECT n FROM b QUALIFY row_number() OVER (PARTITION BY CASE WHEN authority = 'official' THEN title || '~' || source_name ELSE title END ORDER BY n) = 1")
def w02_first_official(spark: SparkSession, d: str) -> DataFrame:
    return selection.first_wins_official(events(spark, d).select("n", "title", "source_name", "authority"), "n").select("n")


_DIVERSE = "SELECT *, row_number() OVER (PARTITION BY category ORDER BY fraction, risk_rank DESC, n) AS pick, min(n) OVER (PARTITION BY category) AS first FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category, risk_rank ORDER BY ts DESC, n) - 1 AS DOUBLE) / count(*) OVER (PARTITION BY category, risk_rank) AS fraction FROM {x})"


@query(f"{_B} SELECT n, category, risk FROM ({_DIVERSE.format(x='b')}) ORDER BY pick, first LIMIT 250")
def w04_select_diverse(spark: SparkSession, d: str) -> DataFrame:
    return selection.select_diverse(events(spark, d), 250).select("n", "category", "risk")


@query(
    f"""{_B}, floor AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY n) AS p FROM b WHERE authority = 'official') WHERE p <= 3 ORDER BY n LIMIT 250),
g AS (SELECT * FROM b WHERE dataset = 'ds5' AND n NOT IN (SELECT n FROM floor)), general AS (SELECT n FROM ({_DIVERSE.format(x='g')}) ORDER BY pick, first LIMIT (SELECT greatest(0, 50 - count(*)) FROM floor WHERE dataset = 'ds5')),
d AS (SELECT n FROM ({_DIVERSE.format(x='b')}) ORDER BY pick, first LIMIT 250), u AS (SELECT n, 1 AS tier FROM floor UNION ALL SELECT n, 2 FROM general UNION ALL SELECT n, 3 FROM d), m AS (SELECT n, min(tier) AS tier FROM u GROUP BY n) SELECT n, tier FROM m ORDER BY tier, n LIMIT 250"""
)
def w06_floors(spark: SparkSession, d: str) -> DataFrame:
    return selection.select_with_floors(events(spark, d), 250, official=F.col("authority") == "official", general=F.col("dataset") == "ds5").select("n", "tier")


_DRAW = "list_reduce(list_transform(string_split(t, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, u: (xor(h, u) * 16777619) % 4294967296, 2166136261::BIGINT)"


@query(
    f"""{_B}, p AS (SELECT *, row_number() OVER (PARTITION BY category, risk ORDER BY n) - 1 AS i FROM b), k AS (SELECT *, '42|' || category || chr(0) || risk || '|' || id || '|' || i AS t FROM p),
s AS (SELECT *, ({_DRAW} * 1664525 + 1013904223) % 4294967296 AS draw FROM k) SELECT n, category, risk, CAST(row_number() OVER (PARTITION BY category, risk ORDER BY draw, id, i) AS INTEGER) AS pick FROM s QUALIFY pick <= 5"""
)
def w07_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return selection.stratified_sample(events(spark, d)).select("n", "category", "risk", "pick")


@query(f"{_B} SELECT n, row_number() OVER (ORDER BY ts DESC NULLS LAST, n) AS place FROM b")
def t02_newest_first(spark: SparkSession, d: str) -> DataFrame:
    return selection.newest_first(events(spark, d)).select("n", "place")


@query(f"{_B}, x AS (SELECT n, 1 AS tier FROM b WHERE risk_rank = 4 UNION ALL SELECT n, 2 FROM b WHERE n % 5 = 0 UNION ALL SELECT n, 3 FROM b) SELECT n, min(tier) AS tier FROM x GROUP BY n ORDER BY 2, 1 LIMIT 400")
def u03_tiered_union(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("n", "risk_rank")
    return selection.tiered_union([e.where("risk_rank = 4"), e.where("n % 5 = 0"), e], "n", 400).select("n", "tier")


@query(f"{_B} SELECT scope, count(*) AS excluded FROM b WHERE dataset IN ('ds1', 'ds2') GROUP BY scope")
def u04_excluded_counts(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return selection.excluded_counts(e, e.where(filters.is_news_like(F.col("dataset"), ("ds1", "ds2"))), "n", "scope")


@query(
    """WITH w AS (SELECT doc_id, list_distinct(string_split(coalesce(text, ''), ' ')) AS a, list_distinct(string_split(substr(coalesce(text, ''), 60), ' ')) AS b FROM documents)
SELECT doc_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS common, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / least(len(a), len(b)), 6) AS coefficient FROM w"""
)
def u05_overlap(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    words = lambda at: F.split(F.substring(text, F.lit(at), F.greatest(F.length(text), F.lit(1))), " ")
    return spark.read.parquet(f"{d}/documents.parquet").withColumn("o", selection.overlap(words(1), words(60))).select("doc_id", "o.common", F.round("o.coefficient", 6).alias("coefficient"))


@query(f"{_B} SELECT DISTINCT value FROM (SELECT category AS value FROM b UNION ALL SELECT risk FROM b UNION ALL SELECT unnest(['view', 'planned']))")
def u06_domain_union(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return selection.domain_union(spark.createDataFrame([("view",), ("planned",), (None,)], "value string"), e.select("category"), e.select("risk"))


@query(f"{_B}, p AS (SELECT category, region, count(*) AS k FROM b WHERE n % 3 = 0 AND category <> 'view' GROUP BY ALL), c AS (SELECT category, region, count(*) AS k FROM b WHERE n % 3 = 1 AND category <> 'click' GROUP BY ALL) SELECT category, region, coalesce(p.k, 0) AS previous, coalesce(c.k, 0) AS current FROM p FULL JOIN c USING (category, region)")
def u07_merge_keys(spark: SparkSession, d: str) -> DataFrame:
    counts = lambda where: events(spark, d).where(where).groupBy("category", "region").agg(F.count("*").alias("k"))
    return selection.merge_keys(counts("n % 3 = 0 and category <> 'view'"), counts("n % 3 = 1 and category <> 'click'"), ["category", "region"], "k")
