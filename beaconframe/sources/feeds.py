"""Landed documents to rows, and rows to landed tables: feeds, alerts, pages, envelopes; slim sinks.

Texts are read by Spark (`spark.read.text(..., wholetext=True)` or a column of
a table) and taken apart by SQL functions, one row for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconframe.functions.text import collapse_space, strip_markup, strip_page
from beaconframe.operators.selection import first_wins


def _tag(block: Column, *tags: str) -> Column:
    """The text of the first tag of `tags` that has any, markup stripped; null if none."""
    found = [F.nullif(F.regexp_extract(block, rf"(?is)<{t}(?:\s[^>]*)?>(.*?)</{t}>", 1), F.lit("")) for t in tags]
    return F.nullif(strip_markup(F.coalesce(*found)), F.lit(""))


def read_feed_items(df: DataFrame, xml: str, feed: str, per_feed: int | None = None) -> DataFrame:
    """(feed, place, title, link, description, published, publisher, publisher_url) of RSS items and Atom entries.

    Items without a title or link go; `per_feed` keeps the first ones of each document.
    """
    blocks = df.select(feed, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(xml), F.lit("")), F.lit(r"(?is)<(?:item|entry)[\s>].*?</(?:item|entry)>"), F.lit(0))).alias("place", "b"))
    b = F.col("b")
    rss = F.trim(F.regexp_extract(b, r"(?is)<link[^>]*>(.*?)</link>", 1))
    link = F.when(rss.startswith("http"), strip_markup(rss)).otherwise(F.nullif(F.regexp_extract(b, r'(?i)<link[^>]*href="([^"]+)"', 1), F.lit("")))
    items = blocks.select(
        feed, "place", _tag(b, "title").alias("title"), link.alias("link"), _tag(b, "description", "summary", "content").alias("description"), _tag(b, "pubDate", "updated", "published", "dc:date", "date").alias("published"),
        _tag(b, "source").alias("publisher"), F.nullif(F.regexp_extract(b, r'(?i)<source\s+url="([^"]+)"', 1), F.lit("")).alias("publisher_url"),
    ).where("title is not null and link is not null")
    if per_feed is None:
        return items
    w = Window.partitionBy(feed).orderBy("place")
    return items.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= per_feed).drop("_p")


def feed_status(items: DataFrame, attempts: DataFrame, feeds: DataFrame) -> DataFrame:
    """(label, ok, items, error, fallback, gn) of each feed of the catalog (label, url): its attempt (label, ok, error, fallback) and items; gn tells the aggregator's feeds."""
    counts = items.groupBy("label").agg(F.count("*").alias("items"))
    f = feeds.join(attempts, "label", "left").join(counts, "label", "left")
    return f.select("label", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("items", F.lit(0)).alias("items"), F.when(F.coalesce("ok", F.lit(False)), None).otherwise(F.coalesce("error", F.lit("not attempted"))).alias("error"), F.coalesce("fallback", F.lit(False)).alias("fallback"), F.contains("url", F.lit("news.google.com")).alias("gn"))


def rows_as_records(df: DataFrame, body: str, columns: list[str]) -> DataFrame:
    """The rows of {columns, rows} envelopes in a JSON text column, each of `columns` by its name in the envelope; null where the envelope lacks it."""
    e = df.withColumn("_e", F.from_json(body, "struct<columns:array<string>,rows:array<array<string>>>"))
    rows = e.select(*[c for c in df.columns if c != body], F.posexplode("_e.rows").alias("place", "_r"), F.col("_e.columns").alias("_c"))
    at = lambda c: F.array_position("_c", F.lit(c))
    return rows.select(*[c for c in rows.columns if c not in ("_r", "_c")], *(F.when(at(c) > 0, F.get("_r", at(c).cast("int") - 1)).alias(c) for c in columns))


def read_open_data(df: DataFrame, body: str, schema: str, paths: tuple[str, ...] = ("data", "records", "result", "results", "items", "payload")) -> DataFrame:
    """Records of a JSON text column: a list itself, or the list at the first of the paths, also one level below it. `schema` is a record's DDL."""
    text, parsed = F.col(body), f"array<{schema}>"
    inner = [f"$.{p}" for p in paths] + [f"$.{p}.{q}" for p in paths for q in paths]
    lists = [F.when(F.ltrim(text).startswith("["), F.from_json(text, parsed))]
    lists += [F.when(F.get_json_object(text, path).startswith("["), F.from_json(F.get_json_object(text, path), parsed)) for path in inner]
    return df.select(*[c for c in df.columns if c != body], F.posexplode(F.coalesce(*lists)).alias("place", "_r")).select(*[c for c in df.columns if c != body], "place", "_r.*")


def extract_html_rows(df: DataFrame, html: str, cells: int, keep: list[str], row: str = r"(?is)<tr[^>]*>.*?</tr>", cell: str = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>") -> DataFrame:
    """(keep, place, cells) of the rows of a page's tables that have `cells` cells or more; cells are stripped texts."""
    rows = df.select(*keep, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(row), F.lit(0))).alias("place", "_r"))
    found = F.transform(F.regexp_extract_all("_r", F.lit(cell), F.lit(1)), strip_page)
    return rows.select(*keep, "place", found.alias("cells")).where(F.size("cells") >= cells)


def reservoir_rows(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """(name, storage, rate, at, planned_empty) of reservoir tables: five cells, the rate without its percent sign."""
    r = extract_html_rows(df, html, 5, keep)
    number = lambda i: F.regexp_replace(F.get("cells", F.lit(i)), "[%,\\s]", "").try_cast("double")
    return r.select(*keep, F.get("cells", F.lit(0)).alias("name"), number(1).alias("storage"), number(3).alias("rate"), F.get("cells", F.lit(4)).alias("at"), F.array_contains(F.transform("cells", lambda c: c.rlike("放空|空庫")), True).alias("planned_empty")).where("rate is not null or planned_empty")


def extract_html_links(df: DataFrame, html: str, keep: list[str], parameter: str = "id") -> DataFrame:
    """(id, title, date, url) of links whose address has the parameter, the first of each id on the page: a date at the end of the text is split off it."""
    links = df.select(*keep, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))).alias("place", "_a"))
    url = F.replace(F.regexp_extract("_a", r'(?i)href="([^"]*)"', 1), F.lit("&amp;"), F.lit("&"))
    text = strip_page(F.regexp_extract("_a", r"(?is)^<a[^>]*>(.*)</a>$", 1))
    date = r"[\s(（]*(\d{2,4}[-/.]\d{1,2}[-/.]\d{1,2})[)）]*$"
    named = links.select(*keep, "place", F.nullif(F.regexp_extract(url, rf"[?&]{parameter}=([^&#]+)", 1), F.lit("")).alias("id"), F.trim(F.regexp_replace(text, date, "")).alias("title"), F.nullif(F.regexp_extract(text, date, 1), F.lit("")).alias("date"), url.alias("url"))
    return first_wins(named.where("id is not null"), F.concat_ws("\x1f", *keep, "id"), "place").drop("place")


def extract_weekly_reports(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """(year, week, range, url, title) of the cells `weeks`, `date` and `link` of report tables."""
    rows = df.select(*keep, F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)<tr[^>]*>.*?</tr>"), F.lit(0))).alias("_r"))
    cell = lambda name: F.regexp_extract("_r", rf'(?is)<td[^>]*headers="{name}"[^>]*>(.*?)</td>', 1)
    weeks = strip_page(cell("weeks"))
    p = r"(\d{4})\D+(\d{1,2})"
    out = rows.select(*keep, F.regexp_extract(weeks, p, 1).try_cast("int").alias("year"), F.regexp_extract(weeks, p, 2).try_cast("int").alias("week"), strip_page(cell("date")).alias("range"), F.regexp_extract(cell("link"), r'(?i)href="([^"]+)"', 1).alias("url"), strip_page(cell("link")).alias("title"))
    return out.where("year is not null and url <> ''").orderBy(F.desc(F.col("year") * 100 + F.col("week")))


def parse_cap(df: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """The fields of CAP 1.2 alerts, whatever the namespace prefix: those of the alert, and of the first info and area in it."""
    block = lambda c, t: F.regexp_extract(c, rf"(?is)<(?:\w+:)?{t}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{t}>", 1)
    field = lambda c, t: F.nullif(_plain(block(c, t)), F.lit(""))
    # A step for the alert and one for its first info: each block is cut out once, not once for each of its fields.
    found = df.select(*keep, F.coalesce(F.col(xml), F.lit("")).alias("_alert"))
    found = found.select(*keep, "_alert", block("_alert", "info").alias("_info"))
    top = [field("_alert", t).alias(t) for t in ("identifier", "sender", "sent", "status", "msgType", "scope")]
    inner = [field("_info", t).alias(t) for t in ("category", "event", "urgency", "severity", "certainty", "effective", "expires", "headline", "description")]
    return found.select(*keep, *top, *inner, field(block("_info", "area"), "areaDesc").alias("areaDesc")).where("identifier is not null")


def _plain(raw: Column) -> Column:
    """A field's text without markup; only one with a sign of markup is searched for it."""
    return F.transform(F.array(raw), lambda c: F.when(c.rlike("[<&]"), strip_markup(c)).otherwise(collapse_space(c)))[0]


def read_article_list(df: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """(title, link, published, aggregator) of article lists in a JSON text column: the mobile address first, web addresses and titles only, the first of each link."""
    a = df.select(*keep, F.posexplode(F.from_json(body, "struct<articles:array<struct<url:string,url_mobile:string,title:string,seendate:string>>>")["articles"]).alias("place", "a"))
    link = F.coalesce(F.nullif(F.trim("a.url_mobile"), F.lit("")), F.trim("a.url"))
    some = a.select(*keep, "place", collapse_space(F.col("a.title")).alias("title"), link.alias("link"), F.col("a.seendate").alias("published"), F.lit("aggregated").alias("confidence"))
    return first_wins(some.where(F.col("link").rlike("^https?://") & (F.col("title") != "")), "link", "place").drop("place")


def select_feeds(catalog: DataFrame, tier: str, topic: str | None = None) -> DataFrame:
    """Feeds of a tier (core; expanded has core too; bulk all) and of a topic, which is the feed's own or among its topics."""
    tiers = {"core": ("core",), "expanded": ("core", "expanded"), "bulk": ("core", "expanded", "bulk")}[tier]
    some = catalog.where(F.col("tier").isin(*tiers))
    return some if topic is None else some.where((F.col("topic") == topic) | F.coalesce(F.array_contains("topics", topic), F.lit(False)))


def slim_events(df: DataFrame, drop: tuple[str, ...] = ("aiEntities", "threatActors", "relations", "implications", "groundedRatio")) -> DataFrame:
    """Events without the model's columns and without source.query; source.url stays only where it is not the record reference."""
    url = F.when(~F.col("source.url").eqNullSafe(F.col("source.recordRef")), F.col("source.url"))
    return df.drop(*drop).withColumn("source", F.col("source").dropFields("query").withField("url", url))


def map_points(df: DataFrame) -> DataFrame:
    """The eleven columns of a map's points, of events that can be placed."""
    there = F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~((F.col("lat") == 0) & (F.col("lng") == 0))
    return df.where(there).select("id", "title", "region", "lat", "lng", "ts", "category", "risk", "scope", "source_name", "dataset")


def lookup_snapshot(df: DataFrame, datasets: tuple[str, ...], generated: Column) -> DataFrame:
    """The rows of the look-up datasets with the time of the snapshot."""
    return df.where(F.col("dataset").isin(*datasets)).withColumn("generated_at", generated)


def union_sources(*frames: DataFrame) -> DataFrame:
    """All sources' rows as one table; columns that a source lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
