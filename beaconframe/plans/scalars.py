"""Queries of the column functions: one for each family, on whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconframe.functions import dates as D
from beaconframe.functions import places as P
from beaconframe.functions import rules as R
from beaconframe.functions import text as T
from beaconframe.plans.registry import Registry

query = Registry()
NOW = datetime(2024, 1, 20)
_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# Titles are the first lines of the documents with a media suffix, links are made of their ids.
_ITEMS = "i AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) || ' - ' || source AS title, CASE WHEN doc_id % 11 <> 0 THEN 'https://www.' || source || '.example/x?' || doc_id END AS link, lang, source, text FROM documents)"
_SUFFIX = r"'[ \t\n\f\r\x0B]*[-|｜–—][ \t\n\f\r\x0B]*[^-|｜–—]{1,20}$', ''"
_DJB2 = "lower(to_base(list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split({x}, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, n: CASE WHEN n > 65535 THEN (((h * 33 + 55296 + ((n - 65536) >> 10)) % 4294967296) * 33 + 56320 + ((n - 65536) & 1023)) % 4294967296 ELSE (h * 33 + n) % 4294967296 END), 36))"


def _items(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    link = F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("https://www."), "source", F.lit(".example/x?"), F.col("doc_id").cast("string")))
    return docs.select("doc_id", F.concat(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), F.lit(" - "), "source").alias("title"), link.alias("link"), "lang", "source", "text")


@query(
    f"""WITH {_ITEMS}, t AS (SELECT *, regexp_replace(title, {_SUFFIX}) AS bare FROM i)
SELECT doc_id, coalesce(nullif(trim(bare, ' '), ''), trim(title, ' ')) AS clean_title, lower(regexp_replace(bare, '[^\\x{{4E00}}-\\x{{9FFF}}A-Za-z0-9]', '', 'g')) AS title_key,
  CASE WHEN link IS NOT NULL THEN {_DJB2.format(x="link")} END AS link_hash, CASE WHEN link IS NOT NULL THEN CASE WHEN lang = 'en' THEN 'twnews-' ELSE 'intl-' END || {_DJB2.format(x="link")} END AS event_id,
  'doc-' || substr(sha1(title), 1, 16) AS stable_id, source || ':' || coalesce(link, CAST(doc_id AS VARCHAR)) AS fingerprint,
  coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN source END, ''), CASE WHEN doc_id % 3 = 1 THEN lang || ' 聚合' END, 'name') AS display_name,
  CASE WHEN link IS NULL THEN '' ELSE source || '.example' END AS needle FROM t"""
)
def p01_titles_and_ids(spark: SparkSession, d: str) -> DataFrame:
    """P01-P06, P34, P36 on the documents' titles and links."""
    i = _items(spark, d)
    third = F.col("doc_id") % 3
    return i.select(
        "doc_id", T.clean_title(F.col("title")).alias("clean_title"), T.title_key(F.col("title")).alias("title_key"), F.when(F.col("link").isNotNull(), T.djb2_36(F.col("link"))).alias("link_hash"),
        T.event_id(F.when(F.col("lang") == "en", "domestic").otherwise("international"), F.col("link")).alias("event_id"), T.stable_id("doc", F.col("title")).alias("stable_id"),
        T.fingerprint(F.col("source"), F.col("link"), F.col("doc_id"), F.col("title")).alias("fingerprint"),
        T.display_name(F.when(third == 0, F.col("source")), F.when(third == 1, F.col("lang")), F.lit("name")).alias("display_name"), T.query_needle(F.col("link")).alias("needle"),
    )


_WS = r"[ \t\n\f\r\x0B\x{00A0}\x{3000}]+"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'), ' ')"


_TAGS = "regexp_replace({x}, '<[^>]+>', ' ', 'g')"
_PAGE = "regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!\\[CDATA\\[(.*?)\\]\\]>', '\\1', 'gs'), '<script.*?</script>', ' ', 'gis'), '<style.*?</style>', ' ', 'gis')"


def _entities(x: str, table, flags: str) -> str:
    for pattern, by in table:
        x = "regexp_replace({}, '{}', '{}', '{}')".format(x, *(t.replace("'", "''") for t in (pattern, by)), flags)
    return x


_FEED_TEXT = _collapse(_TAGS.format(x=_entities(_TAGS.format(x="regexp_replace(coalesce(html, ''), '<!\\[CDATA\\[(.*?)\\]\\]>', '\\1', 'gs')"), T.ENTITIES, "g")))
_PAGE_TEXT = _collapse(_entities(_TAGS.format(x=_PAGE), T.PAGE_ENTITIES, "gi"))


@query(
    f"""WITH p AS (SELECT page_id, {_FEED_TEXT} AS feed_text, {_PAGE_TEXT} AS page_text, {_collapse("regexp_replace(coalesce(html, ''), '</?[a-zA-Z][^>]*>', '', 'g')")} AS bare FROM pages)
SELECT page_id, sha256(feed_text) AS feed_text, sha256(page_text) AS page_text, sha256(bare) AS bare, CASE WHEN length(page_text) > 120 THEN substr(page_text, 1, 119) || '…' ELSE page_text END AS compact,
  substr(page_text, 1, 80) AS cut, CASE WHEN length(bare) > 50 THEN substr(bare, 1, 50) || '…' ELSE bare END AS truncated FROM p"""
)
def p07_markup(spark: SparkSession, d: str) -> DataFrame:
    """P07-P09 on the pages; the long texts as digests."""
    p = _read(spark, d, "pages").select("page_id", T.strip_markup(F.col("html")).alias("feed_text"), T.strip_page(F.col("html")).alias("page_text"), T.strip_html(F.col("html")).alias("bare"))
    digests = [F.sha2(F.col(c), 256).alias(c) for c in ("feed_text", "page_text", "bare")]
    return p.select("page_id", *digests, T.compact(F.col("page_text"), 120).alias("compact"), T.compact(F.col("page_text"), 80, hard=True).alias("cut"), T.truncate(F.col("bare"), 50).alias("truncated"))


_DAY = "CAST(o_orderdate AS DATE)"


@query(
    f"""WITH o AS (SELECT o_orderkey, {_DAY} AS d, o_orderkey % 24 AS h, o_orderkey % 60 AS m FROM orders), f AS (SELECT *, strftime(d, '%Y-%m-%d') AS iso, lpad(CAST(h AS VARCHAR), 2, '0') AS hh, lpad(CAST(m AS VARCHAR), 2, '0') AS mm FROM o)
SELECT o_orderkey, iso || 'T12:00:00+08:00' AS roc, iso || 'T' || hh || ':' || mm || ':00+08:00' AS roc_time, strftime(d, '%Y-%m-01') || 'T00:00:00+08:00' AS roc_month, iso || 'T' || hh || ':' || mm || ':00+08:00' AS chinese,
  strftime(CAST(d AS TIMESTAMP) + to_hours(h) + to_minutes(m) - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS official, iso || 'T12:00:00+08:00' AS eight, iso || 'T12:00:00+08:00' AS slash,
  iso || 'T' || hh || ':' || mm || ':00+08:00' AS slash_time, iso || 'T' || hh || ':' || mm || ':00+08:00' AS local, iso || 'T' || hh || ':' || mm || ':00+08:00' AS half_day, iso || 'T' || hh || ':' || mm || ':00+08:00' AS parts,
  iso || 'T' || hh || ':' || mm || ':00.000Z' AS compact, iso || 'T' || hh || ':' || mm || '+08:00' AS with_offset FROM f"""
)
def p10_calendars(spark: SparkSession, d: str) -> DataFrame:
    """The orders' dates written in every calendar and form, and read back."""
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    h, m = (key % 24).cast("string"), F.lpad((key % 60).cast("string"), 2, "0")
    hh = F.lpad(h, 2, "0")
    roc = F.lpad((F.year(day) - D.ROC).cast("string"), 3, "0")
    f = lambda p: F.date_format(day, p)
    hour = key % 24
    half = F.concat(f("yyyy/M/d "), F.when(hour >= 12, "下午").otherwise("上午"), F.lit(" "), F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string"), F.lit(":"), m)
    return _read(spark, d, "orders").select(
        "o_orderkey", D.roc_date(F.concat(roc, f("MMdd"))).alias("roc"), D.roc_datetime(F.concat(roc, f("MMdd"), hh, m)).alias("roc_time"), D.roc_month(F.concat(roc, f("MM"))).alias("roc_month"),
        D.roc_chinese(F.concat(roc.cast("int").cast("string"), F.lit("年"), f("M"), F.lit("月"), f("d"), F.lit("日 "), h, F.lit("時"), m, F.lit("分"))).alias("chinese"),
        D.official_date(F.concat(roc, f(".M.d"), F.lit("(x) "), h, F.lit(":"), m), F.lit("none")).alias("official"), D.gregorian_date(F.concat(F.when(F.year(day) < 2000, f("yyyy-MM-dd")).otherwise(f("yyyyMMdd")))).alias("eight"),
        D.slash_date(F.concat(F.lit("on "), f("yyyy/M/d"))).alias("slash"), D.slash_datetime(F.concat(f("yyyy/M/d "), h, F.lit(":"), m)).alias("slash_time"), D.local_datetime(F.concat(f("yyyy-M-d "), h, F.lit(":"), m)).alias("local"),
        D.local_datetime(half).alias("half_day"), D.date_and_time(f("yyyyMMdd"), F.concat(h, m, F.lit("00"))).alias("parts"), D.compact_utc(F.concat(f("yyyyMMdd"), F.lit("T"), hh, m, F.lit("00Z"))).alias("compact"),
        D.apply_offset(F.concat(f("yyyy-MM-dd "), hh, F.lit(":"), m), "+08:00").alias("with_offset"),
    )


query.sql["p10_calendars"] = query.sql["p10_calendars"].replace("iso || 'T12:00:00+08:00' AS eight", "CASE WHEN iso >= '2000' THEN iso || 'T12:00:00+08:00' END AS eight")


@query(
    f"""WITH o AS (SELECT o_orderkey, {_DAY} AS d FROM orders)
SELECT o_orderkey, CAST(date_trunc('week', make_date(year(d), 1, 4)) AS DATE) + CAST((weekofyear(d) - 1) * 7 + 6 AS INTEGER) AS week_end, strftime(last_day(d), '%Y-%m-%d') || 'T15:59:59.000Z' AS month_end, year(d) || '-12-31T15:59:59.000Z' AS year_end,
  strftime(CASE o_orderkey % 4 WHEN 0 THEN make_date(year(d), month(d), 10) WHEN 1 THEN make_date(year(d), month(d), 20) WHEN 2 THEN least(last_day(d), CAST(date_trunc('month', d) AS DATE) + 29) ELSE make_date(year(d), month(d), 15) END, '%Y-%m-%d') AS ten_days,
  strftime(last_day(d), '%Y-%m-%d') AS range_end, CASE WHEN o_orderkey % 2 = 0 THEN year(d) - 1911 END AS period_year, CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(d) - 1911 AS VARCHAR) || strftime(d, '%m') END AS period_key,
  strftime(CAST(d AS TIMESTAMP) + to_hours(o_orderkey % 24) + INTERVAL 8 HOUR, '%Y-%m-%d') AS local_day, strftime(CAST(d AS TIMESTAMP) + to_hours(o_orderkey % 24) + INTERVAL 8 HOUR, '%Y-%m-%d %H:00') AS local_hour FROM o"""
)
def p13_periods(spark: SparkSession, d: str) -> DataFrame:
    """Ends of the periods that hold the orders' dates, period labels, local days and hours."""
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    roc = (F.year(day) - D.ROC).cast("string")
    part = F.element_at(F.array(*map(F.lit, ("上旬", "中旬", "下旬", "x"))), (key % 4 + 1).cast("int"))
    label = F.when(key % 2 == 0, F.concat(roc, F.lit("年 "), F.date_format(day, "M"), F.lit("月/ x"))).otherwise(F.concat(roc, F.lit("年 (1~4月)")))
    ts = F.to_timestamp(day) + F.make_interval(hours=(key % 24).cast("int"))
    period = D.roc_period(label)
    return _read(spark, d, "orders").select(
        "o_orderkey", D.iso_week_end(F.year(day), F.weekofyear(day)).alias("week_end"), D.month_end(F.date_format(day, "yyyyMM")).alias("month_end"), D.year_end(F.year(day)).alias("year_end"),
        D.ten_day_date(F.year(day).cast("string"), F.month(day).cast("string"), part).alias("ten_days"), D.roc_month_range_end(F.concat(F.lpad(roc, 3, "0"), F.lit("年1-"), F.date_format(day, "M"), F.lit("月"))).alias("range_end"),
        period["year"].alias("period_year"), period["key"].alias("period_key"), D.local_day(ts).alias("local_day"), D.local_hour(ts).alias("local_hour"),
    )


@query(
    """WITH o AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_linenumber AS k, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN k % 4 <> 0 THEN CAST(cents AS DOUBLE) END AS number, CASE WHEN k % 4 <> 0 THEN CAST(cents AS DOUBLE) ELSE 0.0 END AS cell, 'NT$' || format('{:,}', cents) AS ntd,
  22 + CAST(s % 40 AS DOUBLE) / 10 AS lat, 118 + CAST(s % 40 AS DOUBLE) / 10 AS lng, s % 5 <> 0 AS valid, s % 40 <= 20 AS in_box, q AS deaths, k AS injuries,
  round(2 * 6371.0088 * asin(sqrt(power(sin(radians(24.0 - (22 + s % 40 / 10)) / 2), 2) + cos(radians(22 + s % 40 / 10)) * cos(radians(24.0)) * power(sin(radians(121.0 - (118 + s % 40 / 10)) / 2), 2))), 4) AS km,
  CASE WHEN k IN (1, 2) THEN 'high' ELSE 'medium' END AS risk, CAST(least(100, q * 3) AS INTEGER) AS score FROM o"""
)
def p16_numbers_and_places(spark: SparkSession, d: str) -> DataFrame:
    """P16-P21, P26 on the line items' prices, quantities and suppliers."""
    cents, k, s = F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_linenumber"), F.col("l_suppkey")
    text = F.when(k % 4 == 0, "…").otherwise(F.concat(F.format_number(cents, 0), F.lit("r")))
    lat, lng = 22 + (s % 40) / 10, 118 + (s % 40) / 10
    pair = P.parse_coord_pair(F.when(s % 2 == 0, F.concat_ws(", ", lat.cast("string"), lng.cast("string"))).otherwise(F.concat_ws(",", lng.cast("string"), lat.cast("string"))))
    hurt = P.parse_casualties(F.concat(F.lit("死亡 "), F.col("l_quantity").cast("long").cast("string"), F.lit("; 受傷"), k.cast("string")))
    zero = F.when(s % 5 == 0, 0.0)
    return _read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", P.clean_number(text).alias("number"), P.cell_number(F.regexp_replace(text, "r", "")).alias("cell"), P.format_ntd(cents.cast("string")).alias("ntd"), pair["lat"].alias("lat"), pair["lng"].alias("lng"),
        P.valid_coord(F.coalesce(zero, lat), F.coalesce(zero, lng)).alias("valid"), P.in_bbox(lat, lng, 22, 118, 24, 121).alias("in_box"), hurt["deaths"].cast("long").alias("deaths"), hurt["injuries"].alias("injuries"),
        F.round(P.haversine_km(lat, lng, F.lit(24.0), F.lit(121.0)), 4).alias("km"), P.clamp_enum(F.when(k.isin(1, 2), "high").otherwise("?"), R.RISKS, "medium").alias("risk"), P.clamp_score(F.col("l_quantity") * 3).alias("score"),
    )





@query(
    """WITH w AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ' '), lambda x: trim(x, ' ')) AS w FROM documents),
c AS (SELECT *, list_filter(w, lambda x: length(x) BETWEEN 2 AND 14) AS good FROM w),
d AS (SELECT doc_id, w, list_filter(good, lambda x, i: list_position(good, x) = i)[1:5] AS names FROM c)
SELECT doc_id, CASE WHEN len(names) > 0 THEN array_to_string(names, '|') END AS names, CASE WHEN length(w[1]) BETWEEN 1 AND 24 AND length(w[2]) BETWEEN 1 AND 24 THEN w[1] || '>' || w[2] END AS relation FROM d"""
)
def p23_arrays(spark: SparkSession, d: str) -> DataFrame:
    """P23, P24 on the words of whole documents."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    one = lambda i: F.get(words, F.lit(i))
    relations = T.clean_relations(F.array(*[F.struct(one(0).alias("from"), one(1).alias("to"), F.lit("next").alias("type"))] * 2))
    first = relations[0]
    return _read(spark, d, "documents").select("doc_id", F.array_join(T.clean_array(words), "|").alias("names"), F.concat(first["from"], F.lit(">"), first["to"]).alias("relation"))


@query(
    """WITH w AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]', '', 'g')) AS h, string_split(coalesce(text, ''), ' ')[1:3] || ['q' || doc_id || 'zz'] AS items FROM documents),
n AS (SELECT *, list_transform(items, lambda x: lower(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g'))) AS k FROM w),
g AS (SELECT doc_id, items, len(list_filter(k, lambda x: x <> '' AND contains(h, x))) AS kept FROM n)
SELECT doc_id, kept, len(items) - kept AS dropped, round(CAST(kept AS DOUBLE) / len(items), 6) AS ratio FROM g"""
)
def p25_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Which of a document's first words (and a made-up one) its text holds in normal form. Its letters are composed already, as NFKC has them."""
    text = F.coalesce("text", F.lit(""))
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    items = F.concat(F.slice(F.split(text, " "), 1, 3), F.array(F.concat(F.lit("q"), F.col("doc_id").cast("string"), F.lit("zz"))))
    docs = _read(spark, d, "documents").select("doc_id", items.alias("items"), T.normalize_for_match(text).alias("h"))
    g = T.ground(F.col("items"), F.transform("items", plain), F.col("h"))
    return docs.withColumn("g", g).select("doc_id", F.col("g.kept").alias("kept"), F.col("g.dropped").alias("dropped"), F.round(T.grounded_ratio(F.col("g")), 6).alias("ratio"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN doc_id END AS id, CASE WHEN doc_id % 3 < 2 THEN lang END AS lang, CASE doc_id % 5 WHEN 0 THEN 'HTTP 401，需要重新授權' WHEN 1 THEN 'HTTP 403，被來源拒絕' WHEN 2 THEN 'HTTP 404，來源路徑失效' WHEN 3 THEN 'HTTP 5xx，來源暫時異常' ELSE 'odd ' || lang END AS failure FROM documents"""
)
def p39_model_output(spark: SparkSession, d: str) -> DataFrame:
    """The documents' ids and languages wrapped as a model would, and read back; failures of each class."""
    key, third = F.col("doc_id"), F.col("doc_id") % 3
    body = F.to_json(F.struct(key.alias("id"), "lang"))
    told = F.when(third == 0, F.concat(F.lit("So: ```json\n["), body, F.lit("]\n``` done"))).when(third == 1, F.concat(F.lit("one "), body, F.lit(" only"))).otherwise("nothing [here")
    code = F.get(F.array(*map(F.lit, ("HTTP 401 x", "<b>403</b>", "got 404", "HTTP 503"))), (key % 5).cast("int"))
    failure = T.compact_failure(F.when(key % 5 == 4, F.concat(F.lit("odd <i>"), "lang", F.lit("</i>"))).otherwise(code))
    found = T.extract_json(told, "array<struct<id:bigint,lang:string>>")
    return _read(spark, d, "documents").select("doc_id", found[0]["id"].alias("id"), found[0]["lang"].alias("lang"), F.regexp_replace(failure, "  +", " ").alias("failure"))
