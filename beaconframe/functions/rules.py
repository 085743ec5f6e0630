"""Classification rules: thresholds and ordered patterns as Columns. Tables of patterns are parameters with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconframe.functions import vocabulary as V
from beaconframe.functions.places import parse_casualties
from beaconframe.functions.text import strip_html

RISKS = ("low", "medium", "high", "critical")
#: The letters that each match of a Chinese risk pattern ends with.
CJK = "[一-鿿]"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _any(c: Column, pattern: str) -> Column:
    return _text(c).rlike(pattern)


def risk_rank(c: Column, otherwise: int = 1) -> Column:
    """0 to 3 for low to critical; `otherwise` (medium) for what is neither."""
    out = F.when(c == RISKS[0], 0)
    for i, risk in enumerate(RISKS[1:], 1):
        out = out.when(c == risk, i)
    return out.otherwise(otherwise)


def by_threshold(c: Column, steps: tuple[tuple[float, str], ...], otherwise: str = "low", missing: str = "low") -> Column:
    """The risk of the first step that the number reaches; `missing` for what is no number."""
    n = c.try_cast("double")
    out = F.when(n.isNull(), missing)
    for least, risk in steps:
        out = out.when(n >= least, risk)
    return out.otherwise(otherwise)


def by_terms(c: Column, terms: tuple[tuple[str, str], ...], otherwise: str = "low") -> Column:
    """The risk of the first pattern that the text holds."""
    out = F.when(_any(c, terms[0][0]), terms[0][1])
    for pattern, risk in terms[1:]:
        out = out.when(_any(c, pattern), risk)
    return out.otherwise(otherwise)


def categorize(title: Column, hint: Column, rules: tuple[tuple[str, str], ...] = V.CATEGORY_RULES, hints: tuple[str, ...] = V.HINTS, otherwise: str = V.CATEGORY) -> Column:
    """struct(category, basis) by the first rule that the title meets, else by the hint, else `otherwise`."""
    told = lambda category, basis: F.struct(category.alias("category"), basis.alias("basis"))
    out = F.when(hint.isin(*hints), told(hint, F.concat(F.lit("hint:"), hint))).otherwise(told(F.lit(otherwise), F.lit("default")))
    for pattern, category in reversed(rules):
        out = F.when(_any(title, pattern), told(F.lit(category), F.lit(f"rule:{category}"))).otherwise(out)
    return out


def rate_risk(title: Column, hint: Column, description: Column) -> Column:
    """The risk of a news item by ordered patterns on its title and description; the hint's own patterns come before the general ones.

    All patterns but the English ones end with a CJK letter, so they look into a description that has none no further than the title.
    """
    both = F.concat(_text(title), F.lit(" "), _text(description))
    parts = F.struct(_text(title).alias("title"), hint.alias("hint"), both.alias("both"), F.when(_text(description).rlike(CJK), both).otherwise(_text(title)).alias("cjk"))
    # As the parameter of a function the texts are made once for all patterns.
    return F.transform(F.array(parts), _rated)[0]


def _rated(t: Column) -> Column:
    """The risk of a struct (title, hint, both, cjk) of `rate_risk`."""
    has, in_english = (lambda p: t["cjk"].rlike(p)), (lambda p: t["both"].rlike(p))
    routine = t["title"].rlike(V.ROUTINE)
    cyber_routine = routine | t["title"].rlike(V.CYBER_ROUTINE)
    high, medium = has(V.HIGH) | in_english(V.HIGH_EN), has(V.MEDIUM) | in_english(V.MEDIUM_EN)
    mild = F.when(medium, "medium").otherwise("low")
    out = F.when(has(V.CRITICAL) & ~has(V.NO_CASUALTY), "critical").when(has(V.HIGH_FLOOR), "high").when(~cyber_routine & has(V.CYBER_HIGH), "high")
    out = out.when(~cyber_routine & has(V.DATA_BREACH), F.when(has(V.BREACH_SCALE), "high").otherwise("medium"))
    for topic, (own_high, own_medium) in V.TOPIC_RISKS.items():
        quiet = cyber_routine if topic == V.CYBER else F.lit(False)
        out = out.when(t["hint"] == topic, F.when(quiet, "low").when(has(own_high), "high").when(high, "high").when(routine, "low").when(has(own_medium), "medium").otherwise(mild))
    return out.when(high, "high").when(routine, "low").otherwise(mild)


def calibrate_risk(risk: Column, category: Column, text: Column, relevance: Column, floor: int = 30, categories: tuple[str, ...] = V.BUSINESS, crisis: str = V.CRISIS) -> Column:
    """One level down from critical or high for business news below the relevance floor and without a crisis term; never up."""
    down = category.isin(*categories) & ~_any(text, crisis) & (F.coalesce(relevance, F.lit(0)) < floor)
    return F.when(F.coalesce(down, F.lit(False)) & (risk == "critical"), "high").when(F.coalesce(down, F.lit(False)) & (risk == "high"), "medium").otherwise(risk)


def risk_by_price(c: Column, steps: tuple[float, float, float] = (1e9, 1e8, 1e7)) -> Column:
    """Critical, high and medium from these amounts."""
    return by_threshold(c, tuple(zip(steps, ("critical", "high", "medium"), strict=True)))


def risk_by_speed(daily: Column, yearly: Column) -> Column:
    """By speeding tickets a day or a year."""
    d, y = daily.try_cast("double"), yearly.try_cast("double")
    return F.when((y >= 5000) | (d >= 80), "high").when((y >= 2000) | (d >= 40), "medium").otherwise("low")


def risk_by_blocked(c: Column) -> Column:
    """By the amount of fraud that was blocked; medium without a number."""
    return by_threshold(c, ((1.5e9, "critical"), (8e8, "high"), (3e8, "medium")), missing="medium")


def risk_by_weekly(kind: Column, count: Column) -> Column:
    """By a week's cases, with steps of their own for the gravest kinds and for drugs."""
    n = count.try_cast("double")
    steps = lambda high, medium, below="low": F.when(n >= high, "high").when(n >= medium, "medium").otherwise(below)
    return F.when(n.isNull() | (n <= 0), "low").when(kind.isin("強盜", "強制性交"), steps(3, 0)).when(kind == "毒品", steps(150, 50)).otherwise(steps(100, 30))


def risk_by_casualties(kind: Column, text: Column) -> Column:
    """By deaths and injuries in a text and the accident's class."""

    def rate(t: Column) -> Column:
        found = parse_casualties(t)
        return F.when(found["deaths"] > 0, "critical").when(kind == "A1", "high").when(found["injuries"] >= 3, "high").when(found["injuries"] >= 1, "medium").otherwise("low")

    # As a function's parameter the text is made once; and a stage with such a function runs by several small methods, where one for many columns would be too large for the JVM to compile.
    return F.transform(F.array(text), rate)[0]


def risk_by_case_type(kind: Column) -> Column:
    """Robbery is high, all else medium."""
    return F.when(kind == "強盜", "high").otherwise("medium")


def risk_by_drug(grams: Column, suspects: Column) -> Column:
    """By weight in grams or number of suspects."""
    g, n = grams.try_cast("double"), suspects.try_cast("double")
    return F.when((g >= 1000) | (n >= 5), "high").when((g >= 50) | (n >= 2), "medium").otherwise("low")


def risk_of_police_news(title: Column, content: Column) -> Column:
    """C11."""
    return by_terms(F.concat_ws(" ", title, content), V.POLICE_NEWS_TERMS)


def risk_of_assembly(category: Column, route: Column) -> Column:
    """C11."""
    return by_terms(F.concat_ws(" ", category, route), V.ASSEMBLY_TERMS)


def risk_of_enforcement(text: Column, limit: Column) -> Column:
    """C11: by terms, or by a speed limit of 80 or more."""
    return F.when(F.regexp_replace(_text(limit), r"\D", "").try_cast("double") >= 80, "medium").otherwise(by_terms(text, V.ENFORCEMENT_TERMS))


def risk_of_coast_guard(title: Column) -> Column:
    """C11: drills and lectures first, which are low."""
    return by_terms(title, V.COAST_GUARD_TERMS)


def risk_by_magnitude(c: Column) -> Column:
    """C12."""
    return by_threshold(c, ((6, "critical"), (5, "high"), (4, "medium")))


def risk_by_phenomenon(c: Column) -> Column:
    """From the gravest to the mildest weather phenomenon."""
    return by_terms(c, V.PHENOMENON_TERMS)


def risk_by_reserve(c: Column) -> Column:
    """Power reserve in percent, the lower the graver; low without a number."""
    return F.when(c < 6, "critical").when(c < 10, "high").when(c < 15, "medium").otherwise("low")


def risk_by_storage(c: Column) -> Column:
    """Reservoir storage in percent."""
    return F.when(c <= 20, "high").when(c <= 40, "medium").otherwise("low")


def risk_by_river(level: Column, first: Column, second: Column, third: Column) -> Column:
    """A water level against its station's three alert levels; a blank alert level is none."""
    at = lambda c: level >= F.trim(_text(c)).try_cast("double")
    return F.when(at(first), "high").when(at(second), "medium").when(at(third), "medium").otherwise("low")


def risk_by_air(fine: Column, ozone: Column) -> Column:
    """By fine particles or ozone."""
    return F.when((fine >= 54) | (ozone >= 125), "high").when((fine >= 35) | (ozone >= 100), "medium").otherwise("low")


def risk_of_ruling(title: Column, sentence: Column, outcome: Column) -> Column:
    """C14: by the charge or the sentence."""
    return F.when(_any(title, V.GRAVE_CHARGE) | _any(sentence, "無期徒刑|死刑"), "critical").when(F.coalesce(outcome == "有罪", F.lit(False)) | _any(sentence, "有期徒刑"), "high").otherwise("low")


def risk_of_person(age: Column) -> Column:
    """C14: minors and people of 65 or more are high, all others medium."""
    return F.when((age < 18) | (age >= 65), "high").otherwise("medium")


def risk_of_travel(title: Column) -> Column:
    """C14: by the travel warning's level or colour."""
    return by_terms(title, V.TRAVEL_TERMS)


def risk_of_alert(severity: Column) -> Column:
    """C14: by an alert's severity."""
    return F.when(severity == "Extreme", "critical").when(severity == "Severe", "high").when(severity == "Moderate", "medium").otherwise("low")


def source_kind(kind: Column, authority: Column, dataset: Column, official: tuple[str, ...] = V.OFFICIAL_TYPES) -> Column:
    """Official, news or ''."""
    return F.when(F.coalesce(kind.isin(*official), F.lit(False)) | F.coalesce(authority == "official", F.lit(False)), "official").when(
        F.coalesce(kind == "news-rss", F.lit(False)) | F.coalesce(dataset == "tw-news", F.lit(False)), "news"
    ).otherwise("")


def tag_lexicon(c: Column, lexicon: tuple[tuple[str, str], ...] = V.LEXICON) -> Column:
    """C17: the tags whose pattern the text holds, in the lexicon's order."""
    return F.array_compact(F.array(*(F.when(_any(c, pattern), tag) for pattern, tag in lexicon)))


def is_specific(e: Column, generic: tuple[str, ...] = V.GENERIC_ENTITIES) -> Column:
    """A name of 2 to 14 letters that is not generic."""
    return F.length(e).between(2, 14) & ~e.isin(*generic) & ~e.rlike(V.GENERIC_ENTITY)


def extract_entities(c: Column, supplied: Column | None = None, patterns: tuple[str, ...] = V.ENTITY_PATTERNS, lead: str = V.LEAD_PARTICLES) -> Column:
    """Names by patterns, without leading particles (two letters stay), and supplied names; specific ones only, each once."""
    found = F.flatten(F.array(*(F.regexp_extract_all(_text(c), F.lit(p), F.lit(0)) for p in patterns)))
    stripped = F.transform(found, lambda e: F.regexp_replace(e, f"^[{lead}]+(?=.{{2}})", "")) if lead else found
    every = stripped if supplied is None else F.concat(stripped, F.transform(F.coalesce(supplied, F.array().cast("array<string>")), lambda e: F.trim(_text(e))))
    return F.array_distinct(F.filter(every, lambda e: is_specific(e)))


def shingle(c: Column, region: Column | None = None, stop: tuple[str, ...] = V.STOP_BIGRAMS, words: bool = False) -> Column:
    """The pairs of neighbouring CJK letters of a title without its region's name and stop pairs, each once; or with `words` its lower-case words of two letters or more."""
    text = _text(c)
    if region is not None:
        name = _text(region)
        text = F.when(name == "", text).otherwise(F.replace(text, F.nullif(name, F.lit("")), F.lit("")))
        short = F.when((F.length(name) > 1) & name.rlike("[縣市]$"), F.substring(name, F.lit(1), F.length(name) - 1))
        text = F.when(short.isNull(), text).otherwise(F.replace(text, short, F.lit("")))
    if words:
        return F.array_except(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0)), F.array(*map(F.lit, stop)).cast("array<string>"))
    runs = F.regexp_extract_all(text, F.lit("[一-鿿]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_except(pairs, F.array(*map(F.lit, stop)).cast("array<string>"))


def infer_precision(scope: Column, region: Column, lat: Column, lng: Column, migrated: bool = False) -> Column:
    """How precise an event's place is; `migrated` has the rule for older records, in which missing coordinates are unknown."""
    name, nowhere = _text(region), (lat == 0) & (lng == 0)
    home, world = (name != "") & (name != "全國"), F.contains(name, F.lit("全球"))
    if migrated:
        return F.when(nowhere, "global").when(lat.isNull() | lng.isNull(), "unknown").when(scope == "international", F.when(world, "global").otherwise("country")).otherwise(F.when(home, "city").otherwise("country"))
    there = lat.isNotNull() & lng.isNotNull()
    return F.when(nowhere, "global").when(scope == "domestic", F.when(home, "city").otherwise("country")).when(world, "global").when(there, "country").otherwise("unknown")


def is_aggregated(url: Column) -> Column:
    """The address is of the news aggregator."""
    return F.coalesce(F.regexp_extract(F.lower(_text(url)), r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1) == V.AGGREGATOR_HOST, F.lit(False))


def derive_provenance(label: Column, link: Column, feed_url: Column, publisher: Column, official: Column, advisory: Column) -> Column:
    """Struct of provenance: name, publisher, aggregator, ingest method, confidence, authority, retention policy and query of a news item."""
    via = is_aggregated(feed_url) | is_aggregated(link)
    publisher = F.coalesce(F.nullif(publisher, F.lit("")), F.when(~via, label))
    own = F.coalesce(official, F.lit(False))
    rss = F.concat(F.lit("RSS "), _text(feed_url))
    return F.struct(
        F.coalesce(publisher, F.when(via, V.AGGREGATOR + " 聚合").otherwise(label)).alias("name"), publisher.alias("publisher"), F.when(via, V.AGGREGATOR).alias("aggregator"),
        F.when(via, "google-news-rss").otherwise("direct-rss").alias("ingest_method"), F.when(via, "aggregated").otherwise("verified").alias("confidence"),
        F.when(own, "official").alias("authority"), F.when(F.coalesce(advisory, F.lit(False)), "advisory").alias("retention_policy"),
        F.when(label.startswith("GN "), F.concat(label, F.lit("｜"), rss)).otherwise(rss).alias("query"),
    )


def is_official(url: Column, fallback_url: Column, official: Column, advisory: Column) -> Column:
    """Flagged as official or advisory, or with a government host in one of its (percent-decoded) addresses."""
    raw = F.concat(_text(url), F.lit(" "), _text(fallback_url))
    return F.coalesce(official, F.lit(False)) | F.coalesce(advisory, F.lit(False)) | F.coalesce(F.try_url_decode(raw), raw).rlike(V.GOVERNMENT_HOST)


def impact_domain(category: Column, title: Column, summary: Column) -> Column:
    """What an event touches, by the first pattern that category, title and summary hold."""
    return by_terms(F.concat_ws(" ", category, title, strip_html(summary)), V.IMPACT_DOMAINS, V.NO_IMPACT)


def impact_label(scope: Column, region: Column, precision: Column, relevance: Column, domain: Column) -> Column:
    """Scope and reach of an event before its domain."""
    level = F.when(relevance.isNull(), "對台關聯待判斷").when(relevance >= 70, F.concat(F.lit("高對台關聯 "), relevance)).when(relevance >= 30, F.concat(F.lit("中對台關聯 "), relevance)).otherwise(F.concat(F.lit("低對台關聯 "), relevance))
    reach = F.when(precision.isin("exact", "address", "district"), "附近／區域").when(precision == "city", "縣市層級").when(precision == "country", "全國層級").otherwise(F.coalesce(F.nullif(region, F.lit("")), F.lit("區域待判斷")))
    return F.concat_ws("｜", F.when(scope == "international", F.concat(F.lit("國際｜"), level)).otherwise(reach), domain)


def recommendation(domain: Column, temporal: Column, scope: Column, risk: Column, relevance: Column, unverified: Column) -> Column:
    """What to do about an event. `unverified` is true for news and aggregated sources that no second source confirms."""
    action = F.lit("持續觀察")
    for name, what in V.DOMAIN_ACTIONS:
        action = F.when(domain == name, what).otherwise(action)
    far = F.coalesce((scope == "international") & (relevance < 30), F.lit(False))
    return (
        F.when(temporal == "historical", "作為歷史參考").when(temporal == "judicial", "參考司法結果").when(far & (risk != "critical"), "背景觀察，不升級")
        .when(risk == "critical", F.when(scope == "international", "列入重點追蹤").otherwise("立即避開／處理")).when(unverified & (risk == "high"), "先查證原文再行動")
        .when(risk.isin("high", "medium"), action).otherwise("低優先掃描")
    )


def status_label(temporal: Column, sources: Column, confidence: Column, basis: Column, scope: Column, implications: Column, risk: Column) -> Column:
    """An event's standing; `sources` counts those that report it, null if it is not known."""
    grave = risk.isin("critical", "high")
    return (
        F.when(temporal == "historical", "歷史資料").when(temporal == "judicial", "司法結果").when(sources >= 2, F.concat(sources.cast("string"), F.lit(" 源佐證")))
        .when((sources == 1) & grave, "單一來源待查證").when(confidence == "aggregated", "聚合來源待核").when(basis == "default", "分類待確認")
        .when((scope == "international") & (_text(implications) != ""), "已有影響評估").when(grave, "高優先觀察").otherwise("一般追蹤")
    )


def freshness_label(configured: Column, stale: Column, last: Column, generated: Column) -> Column:
    """How fresh a source is: not configured, failed, unknown, within a day, within three, older."""
    age = F.greatest(F.lit(0), F.unix_micros(generated) - F.unix_micros(last)) / F.lit(86_400_000_000)
    return F.when(configured == F.lit(False), "尚未設定").when(stale, "抓取失敗").when(age.isNull(), "時間未知").when(age <= 1, "同步正常").when(age <= 3, "近期同步").otherwise("需檢查")


def source_decision(label: Column, count: Column, kind: Column) -> Column:
    """What a source is good for, given its `freshness_label`."""
    return (
        F.when(label == "尚未設定", "需設定憑證").when(label.isin("抓取失敗", "需檢查"), "需檢查同步").when(count <= 0, "觀察是否空轉")
        .when(kind.isin("gov-open-data", "cwa"), "可作為主要證據").when(kind == "news-rss", "輔助判斷，需看原文").otherwise("補充來源")
    )


def backfill_provenance(name: Column, query: Column, url: Column, aggregator: Column, precision: Column, note: Column, kind: Column, inferred: Column) -> Column:
    """struct(name, query, aggregator, precision, note, changed) of an older record: query labels out of names, the aggregator named, a missing precision `inferred` and noted."""
    labelled, via = _text(name).startswith("GN "), F.contains(_text(url), F.lit("news.google.com"))
    renamed = via & ~F.coalesce(aggregator == V.AGGREGATOR, F.lit(False))
    placed = _text(precision) == ""
    new = F.when(placed, inferred).otherwise(precision)
    noted = (_text(note) == "") & F.coalesce(kind == "news-rss", F.lit(False)) & (new != "unknown")
    return F.struct(
        F.when(labelled, V.AGGREGATOR + " 聚合").otherwise(name).alias("name"), F.when(labelled, F.concat_ws("｜", name, F.nullif(query, F.lit("")))).otherwise(query).alias("query"),
        F.when(via, V.AGGREGATOR).otherwise(aggregator).alias("aggregator"), new.alias("precision"), F.when(noted, "既有資料遷移標記：新聞座標為概略位置，非原始精準地址").otherwise(note).alias("note"),
        (labelled.cast("int") + renamed.cast("int") + placed.cast("int") + noted.cast("int")).alias("changed"),
    )
