"""Queries of the classification rules, on whole tables. Words that the rules look for are dealt to the rows by their ids."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconframe.functions import dates as D
from beaconframe.functions import places as P
from beaconframe.functions import rules as R
from beaconframe.functions import vocabulary as V
from beaconframe.plans.bindings import EVENTS_SQL, events
from beaconframe.plans.registry import Registry

query = Registry()
NOW = datetime(2024, 1, 20)
_NOW = "TIMESTAMP '2024-01-20 00:00:00'"

#: What the documents' titles say, by doc_id; hints likewise.
TITLES = (
    "三人詐騙落網", "國道車禍 1死", "氣爆造成多人死傷", "失聯移工協尋", "老翁走失 協尋", "資安宣導講座", "勒索軟體癱瘓醫院系統", "個資外洩 百萬筆", "個資外洩", "黑心食品下架", "食物中毒 群聚", "Man arrested for fraud",
    "隨機殺人 無人傷亡", "廢水偷排裁罰", "說明會 竊盜", "shooting leaves one dead", "市政新聞", "毒品工廠查獲", "颱風豪雨 淹水", "台南市火警", "新北命案",
)
HINTS = ("", "治安", "資安", "食安", "衛生", "環境", "其他")


def _pick(words: tuple[str, ...], key) -> F.Column:
    return F.get(F.array(*map(F.lit, words)), F.pmod(key, F.lit(len(words))).cast("int"))


def _sql_pick(words: tuple[str, ...], key: str) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"][({key}) % {len(words)} + 1]"


def _re(text: str, pattern: str) -> str:
    """RE2 has no lookaround: the patterns' negative ones become another letter or the end."""
    pattern = pattern.replace("死(?!角)", "死(?:[^角]|$)").replace("上市(?!櫃|上櫃|公司|企業)", "上市(?:[^櫃上公企]|$)")
    return f"regexp_matches({text}, '{pattern}')"


_ITEMS = f"i AS (SELECT doc_id, {_sql_pick(TITLES, 'doc_id')} AS title, {_sql_pick(HINTS, 'doc_id // 21')} AS hint, coalesce(text, '') AS description FROM documents)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", _pick(TITLES, key).alias("title"), _pick(HINTS, F.floor(key / 21)).alias("hint"), F.coalesce("text", F.lit("")).alias("description"))


def _category_sql() -> str:
    cases = []
    for pattern, category in V.CATEGORY_RULES:
        test = _re("title", pattern) if "(?!" not in pattern else "NOT regexp_matches(title, '失聯移工|命案|兇殺|凶殺|殺人|棄屍|通緝|騙') AND regexp_matches(title, '失蹤|協尋|走失|尋人|失聯|迷航|迷途')"
        cases.append(f"WHEN {test} THEN '{category}|rule:{category}'")
    hints = ", ".join(f"'{h}'" for h in V.HINTS)
    return "CASE " + " ".join(cases) + f" WHEN hint IN ({hints}) THEN hint || '|hint:' || hint ELSE '{V.CATEGORY}|default' END"


def _risk_sql() -> str:
    s, high, medium = "s", f"({_re('s', V.HIGH)} OR {_re('s', V.HIGH_EN)})", f"({_re('s', V.MEDIUM)} OR {_re('s', V.MEDIUM_EN)})"
    routine = _re("title", V.ROUTINE)
    cyber = f"({routine} OR {_re('title', V.CYBER_ROUTINE)})"
    general = f"CASE WHEN {high} THEN 'high' WHEN {routine} THEN 'low' WHEN {medium} THEN 'medium' ELSE 'low' END"
    topics = " ".join(
        f"WHEN hint = '{t}' THEN CASE WHEN {cyber if t == V.CYBER else 'false'} THEN 'low' WHEN {_re(s, h)} THEN 'high' WHEN {high} THEN 'high' WHEN {routine} THEN 'low' WHEN {_re(s, m)} THEN 'medium' ELSE {general} END"
        for t, (h, m) in V.TOPIC_RISKS.items()
    )
    return (
        f"CASE WHEN {_re(s, V.CRITICAL)} AND NOT {_re(s, V.NO_CASUALTY)} THEN 'critical' WHEN {_re(s, V.HIGH_FLOOR)} THEN 'high' WHEN NOT {cyber} AND {_re(s, V.CYBER_HIGH)} THEN 'high' "
        f"WHEN NOT {cyber} AND {_re(s, V.DATA_BREACH)} THEN CASE WHEN {_re(s, V.BREACH_SCALE)} THEN 'high' ELSE 'medium' END {topics} ELSE {general} END"
    )


def _county_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {_re(column, p)} THEN '{name}'" for p, name in P.COUNTY_PATTERNS) + f" ELSE '{P.NATIONAL}' END"


@query(
    f"""WITH {_ITEMS}, t AS (SELECT *, title || ' ' || description AS s FROM i), r AS (SELECT *, {_category_sql()} AS c, {_risk_sql()} AS risk FROM t)
SELECT doc_id, string_split(c, '|')[1] AS category, string_split(c, '|')[2] AS basis, risk, {_county_sql("title")} AS region,
  CASE WHEN doc_id % 3 = 0 AND NOT {_re("title", V.CRISIS)} AND doc_id % 100 < 30 AND risk = 'critical' THEN 'high' WHEN doc_id % 3 = 0 AND NOT {_re("title", V.CRISIS)} AND doc_id % 100 < 30 AND risk = 'high' THEN 'medium' ELSE risk END AS calibrated FROM r"""
)
def c01_news_rules(spark: SparkSession, d: str) -> DataFrame:
    """C01-C03, C15 on items made of the documents."""
    c = R.categorize(F.col("title"), F.col("hint"))
    i = _items(spark, d).withColumn("risk", R.rate_risk(F.col("title"), F.col("hint"), F.col("description")))
    calibrated = R.calibrate_risk(F.col("risk"), F.when(F.col("doc_id") % 3 == 0, "金融").otherwise("治安"), F.col("title"), F.col("doc_id") % 100)
    return i.select("doc_id", c["category"].alias("category"), c["basis"].alias("basis"), "risk", P.detect_county(F.col("title"))["region"].alias("region"), calibrated.alias("calibrated"))


_KINDS, _NEWS, _CASES = ("強盜", "毒品", "竊盜"), ("槍擊", "詐欺 查獲", "一般"), ("闖紅燈", "測速", "遊行 管制")
_SEA, _SKY = ("海難救援", "演練 海難", "偷渡", "淨灘"), ("豪雨", "超大豪雨", "大雨", "多雲")
_CHARGE, _LEVEL = ("殺人", "詐欺", "竊盜"), ("第四級", "橙色", "第二級", "灰色", "x")
_SEVERITY = ("Extreme", "Severe", "Moderate", "Minor")


@query(
    f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS p, CAST(l_quantity AS BIGINT) AS q, l_suppkey AS s, {_sql_pick(_KINDS, 'l_suppkey')} AS kind FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN p >= 50000 THEN 'critical' WHEN p >= 25000 THEN 'high' WHEN p >= 10000 THEN 'medium' ELSE 'low' END AS price,
  CASE WHEN q * 200 >= 5000 OR q * 2 >= 80 THEN 'high' WHEN q * 200 >= 2000 OR q * 2 >= 40 THEN 'medium' ELSE 'low' END AS speed, CASE WHEN p * 50000 >= 1.5e9 THEN 'critical' WHEN p * 50000 >= 8e8 THEN 'high' WHEN p * 50000 >= 3e8 THEN 'medium' ELSE 'low' END AS blocked,
  CASE WHEN kind = '強盜' THEN CASE WHEN q >= 3 THEN 'high' ELSE 'medium' END WHEN kind = '毒品' THEN CASE WHEN q * 4 >= 150 THEN 'high' WHEN q * 4 >= 50 THEN 'medium' ELSE 'low' END WHEN q * 4 >= 100 THEN 'high' WHEN q * 4 >= 30 THEN 'medium' ELSE 'low' END AS weekly,
  CASE WHEN s % 10 = 0 THEN 'critical' WHEN s % 7 = 0 THEN 'high' WHEN q % 5 >= 3 THEN 'high' WHEN q % 5 >= 1 THEN 'medium' ELSE 'low' END AS casualties, CASE WHEN kind = '強盜' THEN 'high' ELSE 'medium' END AS case_type,
  CASE WHEN q * 30 >= 1000 OR s % 6 >= 5 THEN 'high' WHEN q * 30 >= 50 OR s % 6 >= 2 THEN 'medium' ELSE 'low' END AS drug,
  CASE s % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS news, CASE WHEN s % 3 = 2 THEN 'medium' ELSE 'low' END AS assembly, CASE WHEN s % 3 = 0 OR q >= 40 THEN 'medium' ELSE 'low' END AS enforcement,
  ['medium', 'low', 'high', 'low'][s % 4 + 1] AS coast_guard, CASE WHEN q / 7 >= 6 THEN 'critical' WHEN q / 7 >= 5 THEN 'high' WHEN q / 7 >= 4 THEN 'medium' ELSE 'low' END AS magnitude, ['high', 'critical', 'medium', 'low'][s % 4 + 1] AS phenomenon,
  CASE WHEN q < 6 THEN 'critical' WHEN q < 10 THEN 'high' WHEN q < 15 THEN 'medium' ELSE 'low' END AS reserve, CASE WHEN q <= 20 THEN 'high' WHEN q <= 40 THEN 'medium' ELSE 'low' END AS storage,
  CASE WHEN s % 4 <> 0 AND q >= 40 THEN 'high' WHEN q >= 30 THEN 'medium' WHEN q >= 20 THEN 'medium' ELSE 'low' END AS river, CASE WHEN q * 2 >= 54 OR s >= 125 THEN 'high' WHEN q * 2 >= 35 OR s >= 100 THEN 'medium' ELSE 'low' END AS air,
  CASE WHEN s % 3 = 0 OR s % 5 = 0 THEN 'critical' WHEN s % 2 = 0 OR s % 5 = 1 THEN 'high' ELSE 'low' END AS ruling, CASE WHEN q * 2 < 18 OR q * 2 >= 65 THEN 'high' ELSE 'medium' END AS person,
  ['critical', 'high', 'medium', 'low', 'low'][s % 5 + 1] AS travel, ['critical', 'high', 'medium', 'low'][s % 4 + 1] AS alert FROM l"""
)
def c04_official_risks(spark: SparkSession, d: str) -> DataFrame:
    """C04-C14 on the line items' prices, quantities and suppliers; C04 with steps that fit the prices."""
    p, q, s = F.col("l_extendedprice"), F.col("l_quantity").cast("long"), F.col("l_suppkey")
    kind = _pick(_KINDS, s)
    hurt = F.concat(F.when(s % 10 == 0, "死亡 1 ").otherwise("死亡 0 "), F.lit("受傷 "), (q % 5).cast("string"))
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", R.risk_by_price(p, (50_000, 25_000, 10_000)).alias("price"), R.risk_by_speed(q * 2, q * 200).alias("speed"), R.risk_by_blocked(p * 50_000).alias("blocked"), R.risk_by_weekly(kind, F.when(kind == "強盜", q).otherwise(q * 4)).alias("weekly"),
        R.risk_by_casualties(F.when(s % 7 == 0, "A1").otherwise("A2"), hurt).alias("casualties"), R.risk_by_case_type(kind).alias("case_type"), R.risk_by_drug(q * 30, s % 6).alias("drug"), R.risk_of_police_news(_pick(_NEWS, s), F.lit(None).cast("string")).alias("news"),
        R.risk_of_assembly(_pick(_CASES, s), F.lit("")).alias("assembly"), R.risk_of_enforcement(_pick(_CASES, s), F.concat((q * 2).cast("string"), F.lit(" km"))).alias("enforcement"), R.risk_of_coast_guard(_pick(_SEA, s)).alias("coast_guard"), R.risk_by_magnitude(q / 7).alias("magnitude"),
        R.risk_by_phenomenon(_pick(_SKY, s)).alias("phenomenon"), R.risk_by_reserve(q).alias("reserve"), R.risk_by_storage(q).alias("storage"), R.risk_by_river(q, F.when(s % 4 == 0, " ").otherwise("40"), F.lit("30"), F.lit("20")).alias("river"), R.risk_by_air(q * 2, s).alias("air"),
        R.risk_of_ruling(_pick(_CHARGE, s), F.when(s % 5 == 0, "無期徒刑").when(s % 5 == 1, "有期徒刑").otherwise(""), F.when(s % 2 == 0, "有罪")).alias("ruling"), R.risk_of_person(q * 2).alias("person"), R.risk_of_travel(_pick(_LEVEL, s)).alias("travel"), R.risk_of_alert(_pick(_SEVERITY, s)).alias("alert"),
    )


#: A lexicon in the languages of the documents.
LEXICON = (("(?i)the|and", "english"), ("(?i)der|und", "german"), ("(?i)les|est", "french"), (r"[0-9]", "number"), ("@", "mail"))
_STOP = ("the", "and", "la", "de", "der", "die")


@query(
    f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, {_sql_pick(TITLES, 'doc_id')} AS title FROM documents),
w AS (SELECT *, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]{{2,}}') AS w, list_concat(regexp_extract_all(t, '[A-Z][a-z]{{3,}}'), ['Own' || doc_id]) AS e FROM t)
SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{tag}' END" for p, tag in LEXICON)}], lambda x: x IS NOT NULL), ',') AS tags,
  array_to_string(list_filter(e, lambda x, i: length(x) <= 14 AND list_position(e, x) = i), ',') AS entities, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i AND x NOT IN {_STOP}), ',') AS words FROM w"""
)
def c17_signals(spark: SparkSession, d: str) -> DataFrame:
    """C17-C19 on the documents, with a lexicon, entity patterns and words of their languages."""
    text = F.coalesce("text", F.lit(""))
    own = F.array(F.concat(F.lit("Own"), F.col("doc_id").cast("string")))
    entities = R.extract_entities(text, own, (r"[A-Z][a-z]{3,}",), "")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(R.tag_lexicon(text, LEXICON), ",").alias("tags"), F.array_join(entities, ",").alias("entities"), F.array_join(R.shingle(text, None, _STOP, True), ",").alias("words"))


@query(
    f"""WITH {EVENTS_SQL}, t AS (SELECT *, {_sql_pick(TITLES, 'n')} AS news FROM b)
SELECT n, CASE WHEN source_type = 'gov-open-data' OR authority = 'official' THEN 'official' WHEN source_type = 'news-rss' OR dataset = 'ds1' THEN 'news' ELSE '' END AS kind,
  CASE WHEN lat IS NULL THEN CASE WHEN scope = 'domestic' THEN 'city' ELSE 'unknown' END WHEN scope = 'domestic' THEN 'city' ELSE 'country' END AS precision, CASE WHEN lat IS NULL THEN 'unknown' WHEN scope = 'international' THEN 'country' ELSE 'city' END AS migrated,
  CASE WHEN n % 13 = 0 THEN 'judicial' WHEN category = 'view' THEN NULL WHEN ts < {_NOW} - INTERVAL 10 DAY THEN 'historical' END AS temporal, CASE WHEN ts > {_NOW} + INTERVAL 5 DAY THEN CASE WHEN n % 2 = 0 THEN TIMESTAMP '2024-01-19 00:00:00' ELSE {_NOW} END ELSE ts END AS clamped_ts,
  ts > {_NOW} + INTERVAL 5 DAY AS clamped, round((epoch_us({_NOW}) - epoch_us(ts)) / 3.6e9, 4) AS stale_hours,
  CASE WHEN n % 10 = 0 THEN '尚未設定' WHEN n % 7 = 0 THEN '抓取失敗' WHEN greatest(0, epoch_us({_NOW}) - epoch_us(ts)) <= 86400000000 THEN '同步正常' WHEN epoch_us({_NOW}) - epoch_us(ts) <= 259200000000 THEN '近期同步' ELSE '需檢查' END AS fresh,
  CASE WHEN n % 10 = 0 THEN '需設定憑證' WHEN n % 7 = 0 OR greatest(0, epoch_us({_NOW}) - epoch_us(ts)) > 259200000000 THEN '需檢查同步' WHEN n % 3 = 0 AND n % 9 = 0 THEN '觀察是否空轉' WHEN source_type = 'gov-open-data' THEN '可作為主要證據' WHEN source_type = 'news-rss' THEN '輔助判斷，需看原文' ELSE '補充來源' END AS decision,
  CASE {" ".join(f"WHEN {_re('news', p)} THEN '{x}'" for p, x in V.IMPACT_DOMAINS)} ELSE '{V.NO_IMPACT}' END AS impact FROM t"""
)
def p30_states(spark: SparkSession, d: str) -> DataFrame:
    """C16, P27, P30-P33, P37 on the events."""
    n = F.col("n")
    clamped = D.clamp_future(F.col("ts"), F.when(n % 2 == 0, F.lit(datetime(2024, 1, 19))), NOW, 5)
    fresh = R.freshness_label(n % 10 != 0, n % 7 == 0, F.col("ts"), F.lit(NOW))
    return events(spark, d).select(
        "n", R.source_kind(F.col("source_type"), F.col("authority"), F.when(F.col("dataset") == "ds1", "tw-news")).alias("kind"), R.infer_precision(F.col("scope"), F.col("region"), F.col("lat"), F.col("lng")).alias("precision"),
        R.infer_precision(F.col("scope"), F.col("region"), F.col("lat"), F.col("lng"), migrated=True).alias("migrated"), D.temporal_state(F.when(F.col("category") == "view", D.SEARCH).otherwise(F.col("category")), F.when(n % 13 == 0, "法院宣判").otherwise("x"), F.col("ts"), NOW, 10).alias("temporal"),
        clamped["ts"].cast("timestamp_ntz").alias("clamped_ts"), clamped["clamped"].alias("clamped"), F.round(D.staleness_hours(F.col("ts"), NOW), 4).alias("stale_hours"), fresh.alias("fresh"), R.source_decision(fresh, n % 9, F.col("source_type")).alias("decision"),
        R.impact_domain(F.lit(""), _pick(TITLES, n), F.lit("")).alias("impact"),
    )


@query(
    f"""WITH {EVENTS_SQL}, t AS (SELECT *, CASE WHEN n % 2 = 0 THEN n % 100 END AS rel, ['通行', '健康', '一般注意'][n % 3 + 1] AS domain, CASE n % 11 WHEN 0 THEN 'historical' WHEN 1 THEN 'judicial' END AS temporal, n % 5 < 2 AS unverified, CASE WHEN n % 4 < 3 THEN n % 4 END AS srcs FROM b)
SELECT n, CASE WHEN scope = 'international' THEN '國際｜' || CASE WHEN rel IS NULL THEN '對台關聯待判斷' WHEN rel >= 70 THEN '高對台關聯 ' || rel WHEN rel >= 30 THEN '中對台關聯 ' || rel ELSE '低對台關聯 ' || rel END ELSE ['附近／區域', '縣市層級', '全國層級', region][n % 4 + 1] END || '｜' || domain AS label,
  CASE WHEN temporal = 'historical' THEN '作為歷史參考' WHEN temporal = 'judicial' THEN '參考司法結果' WHEN scope = 'international' AND rel < 30 AND risk <> 'critical' THEN '背景觀察，不升級' WHEN risk = 'critical' THEN CASE WHEN scope = 'international' THEN '列入重點追蹤' ELSE '立即避開／處理' END
    WHEN unverified AND risk = 'high' THEN '先查證原文再行動' WHEN risk IN ('high', 'medium') THEN CASE domain WHEN '通行' THEN '查路況並改道' WHEN '健康' THEN '確認接觸風險' ELSE '持續觀察' END ELSE '低優先掃描' END AS advice,
  CASE WHEN temporal = 'historical' THEN '歷史資料' WHEN temporal = 'judicial' THEN '司法結果' WHEN srcs >= 2 THEN srcs || ' 源佐證' WHEN srcs = 1 AND risk IN ('high', 'critical') THEN '單一來源待查證' WHEN unverified THEN '聚合來源待核' WHEN n % 9 = 0 THEN '分類待確認'
    WHEN scope = 'international' AND n % 8 = 0 THEN '已有影響評估' WHEN risk IN ('high', 'critical') THEN '高優先觀察' ELSE '一般追蹤' END AS status FROM t"""
)
def p32_decisions(spark: SparkSession, d: str) -> DataFrame:
    """P32 on the events."""
    n, scope, risk = F.col("n"), F.col("scope"), F.col("risk")
    rel, domain = F.when(n % 2 == 0, n % 100), _pick(("通行", "健康", "一般注意"), n)
    temporal, unverified = F.when(n % 11 == 0, "historical").when(n % 11 == 1, "judicial"), n % 5 < 2
    return events(spark, d).select(
        "n", R.impact_label(scope, F.col("region"), _pick(("exact", "city", "country", "?"), n), rel, domain).alias("label"), R.recommendation(domain, temporal, scope, risk, rel, unverified).alias("advice"),
        R.status_label(temporal, F.when(n % 4 < 3, n % 4), F.when(unverified, "aggregated"), F.when(n % 9 == 0, "default"), scope, F.when(n % 8 == 0, "x"), risk).alias("status"),
    )


_URLS = ("https://news.google.com/rss/1", "https://a.gov.tw/feed", "https://b.example/x", "https%3A%2F%2Fc.gov.taipei%2F")


@query(
    f"""WITH i AS (SELECT doc_id, {_sql_pick(_URLS, 'doc_id')} AS url, CASE WHEN doc_id % 3 = 0 THEN 'GN ' ELSE '' END || source AS label, CASE WHEN doc_id % 7 = 0 THEN lang END AS publisher FROM documents),
v AS (SELECT *, doc_id % 4 = 0 AS via FROM i)
SELECT doc_id, coalesce(publisher, CASE WHEN via THEN 'Google News 聚合' ELSE label END) AS name, CASE WHEN via THEN 'Google News' END AS aggregator, CASE WHEN via THEN 'google-news-rss' ELSE 'direct-rss' END AS method,
  CASE WHEN via THEN 'aggregated' ELSE 'verified' END AS confidence, CASE WHEN doc_id % 2 = 0 THEN 'official' END AS authority, CASE WHEN doc_id % 5 = 0 THEN 'advisory' END AS policy, CASE WHEN label LIKE 'GN %' THEN label || '｜' ELSE '' END || 'RSS ' || url AS query,
  doc_id % 4 IN (1, 3) OR doc_id % 10 = 0 AS official, CASE WHEN label LIKE 'GN %' THEN 'Google News 聚合' ELSE label END AS new_name, CASE WHEN via THEN 'Google News' ELSE 'none' END AS new_aggregator,
  CAST(label LIKE 'GN %' AS INTEGER) + CAST(via AS INTEGER) + CAST(doc_id % 6 = 0 AS INTEGER) + 1 AS changed FROM v"""
)
def p28_provenance(spark: SparkSession, d: str) -> DataFrame:
    """P28, P29, P38 on feeds and labels made of the documents."""
    key = F.col("doc_id")
    url = _pick(_URLS, key)
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", url.alias("url"), F.concat(F.when(key % 3 == 0, "GN ").otherwise(""), "source").alias("label"), F.when(key % 7 == 0, F.col("lang")).alias("publisher"))
    p = R.derive_provenance(F.col("label"), F.lit("https://x.example/1"), F.col("url"), F.col("publisher"), key % 2 == 0, key % 5 == 0)
    b = R.backfill_provenance(F.col("label"), F.lit(None).cast("string"), F.col("url"), F.lit("none"), F.when(key % 6 != 0, "city"), F.lit(None).cast("string"), F.lit("news-rss"), F.lit("country"))
    return docs.withColumn("p", p).withColumn("b", b).select(
        "doc_id", "p.name", "p.aggregator", F.col("p.ingest_method").alias("method"), "p.confidence", "p.authority", F.col("p.retention_policy").alias("policy"), "p.query", R.is_official(F.col("url"), F.lit(None), key % 10 == 0, F.lit(None)).alias("official"),
        F.col("b.name").alias("new_name"), F.col("b.aggregator").alias("new_aggregator"), F.col("b.changed").alias("changed"),
    )
