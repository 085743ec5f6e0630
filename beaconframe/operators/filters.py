"""Predicates on news and events: noise, relevance, contract, retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconframe.functions import vocabulary as V
from beaconframe.operators.state import small


def _text(*columns: Column) -> Column:
    return F.concat_ws(" ", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))


def is_non_event_noise(title: Column, source: Column) -> Column:
    """entertainment, landing pages and air quality references; a title that tells of an event's action is none, but for the plainest kinds."""
    t = _text(title)
    action = t.rlike(V.EVENT_ACTION)
    plain = t.rlike(V.ENTERTAINMENT) | (t.rlike(V.PRODUCTION) & ~action) | t.rlike(V.CONTROL_SYSTEM)
    weak = t.rlike(V.WEAK_ENTERTAINMENT) | t.rlike(V.LANDING_PAGE) | _text(title, source).rlike(r"(?i)\bIQAir\b") | t.rlike(V.AIR_REFERENCE)
    return plain | (~action & weak)


def is_outreach_noise(title: Column, description: Column, source: Column) -> Column:
    """campaigns, immigration life style and mere politics, unless there is a proceeding or enforcement in it."""
    t, both = _text(title), _text(title, description)
    campaign = both.rlike(V.OUTREACH) & ~both.rlike(V.CRIMINAL_PROCEEDING)
    lifestyle = _text(source).rlike(V.IMMIGRATION_SOURCE) & both.rlike(V.IMMIGRATION_LIFESTYLE) & ~both.rlike(V.IMMIGRATION_ENFORCEMENT)
    politics = (t.rlike(V.PURE_POLITICS) | (t.rlike(V.POLITICAL_CONTEXT) & t.rlike(V.POLITICAL_RHETORIC))) & ~t.rlike(V.CRIMINAL_PROCEEDING)
    return campaign | lifestyle | politics


def is_foreign_only(title: Column, description: Column) -> Column:
    """a foreign place and a disaster or war in the title, and nothing of home in the text once phrases that deny a link are taken out; never for cyber matters."""
    t, both = _text(title), _text(title, description)
    return ~both.rlike(V.CYBER_EXEMPT) & t.rlike(V.FOREIGN_PLACE) & t.rlike(V.FOREIGN_CONTEXT) & ~F.regexp_replace(both, V.HOME_NEGATED, "").rlike(V.HOME_MARKER)


def is_relevant(title: Column, description: Column, source: Column, hint: Column) -> Column:
    """neither noise nor foreign only, and the hint's topic, or for other hints a police matter, is in it."""
    both = _text(title, description)
    topic = both.rlike(V.POLICE) | both.rlike(V.POLICE_EN)
    for name, pattern in V.TOPICS.items():
        topic = F.when(hint == name, both.rlike(pattern)).otherwise(topic)
    return ~is_non_event_noise(title, source) & ~is_foreign_only(title, description) & ~is_outreach_noise(title, description, source) & topic


def is_reference(dataset: Column, ids: tuple[str, ...] = V.REFERENCE_DATASETS) -> Column:
    """the dataset is a list rather than events."""
    return F.coalesce(dataset.isin(*ids), F.lit(False))


def is_news_like(dataset: Column, ids: tuple[str, ...] = V.REFERENCE_DATASETS) -> Column:
    """an event that is not of a reference dataset."""
    return ~is_reference(dataset, ids)


def domain_events(df: DataFrame, members: DataFrame, dataset: str = "dataset", category: str = "category", key: str = "id") -> DataFrame:
    """rows of a domain: by dataset, category, or prefix of the id. `members` has (kind, value) of the three kinds and is a small table."""
    of = lambda kind: members.where(F.col("kind") == kind).select(F.col("value").alias("_v")).distinct()
    by_dataset = df.join(of("dataset"), F.col(dataset) == F.col("_v"), "left_semi")
    by_category = df.join(of("category"), F.col(category) == F.col("_v"), "left_semi")
    by_prefix = df.join(small(of("prefix")), F.col(key).startswith(F.col("_v")), "left_semi")
    return by_dataset.select(key).union(by_category.select(key)).union(by_prefix.select(key)).distinct().join(df, key)


def contract_reason(columns: dict[str, str], scopes: tuple[str, ...] = ("domestic", "international"), risks: tuple[str, ...] = ("low", "medium", "high", "critical")) -> Column:
    """the first reason why an event breaks the contract, null if none. `columns` maps the contract's fields to columns, in the order of the checks."""
    out = F.lit(None).cast("string")
    for field, column in reversed(list(columns.items())):
        c = F.col(column).cast("string")
        allowed = {"scope": scopes, "riskLevel": risks}.get(field)
        if allowed:
            out = F.when(~c.isin(*allowed), F.concat(F.lit(f"{field} 非法:"), c)).otherwise(out)
        out = F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(f"缺 {field}")).otherwise(out)
    return out


def validate_contract(df: DataFrame, columns: dict[str, str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(valid rows, (id, reason) of the others)."""
    told = df.withColumn("_reason", contract_reason(columns))
    identity = F.coalesce(F.nullif(F.trim(F.col(key).cast("string")), F.lit("")), F.lit("(no-id)"))
    return told.where("_reason is null").drop("_reason"), told.where("_reason is not null").select(identity.alias("id"), F.col("_reason").alias("reason"))


def retain(df: DataFrame, now: datetime, days: int = 5, policy: Column | None = None, policies: dict[str, int] | None = None) -> DataFrame:
    """rows that are not older than their policy's days (`days` without one); rows without a time stay."""
    limit = F.lit(days)
    for name, own in (policies or {"advisory": 30}).items():
        limit = F.when(policy == name, own).otherwise(limit) if policy is not None else limit
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(86_400_000_000)
    return df.where(F.col("ts").isNull() | (age <= limit))


def is_displayable(lat: Column, lng: Column) -> Column:
    """both coordinates are there and not both 0."""
    return lat.isNotNull() & lng.isNotNull() & ~F.coalesce((lat == 0) & (lng == 0), F.lit(False))


def priority_items(items: DataFrame, feeds: DataFrame, label: str = "source") -> DataFrame:
    """items of the feeds named in `feeds` (label)."""
    return items.join(feeds.select(F.col("label").alias(label)).distinct(), label, "left_semi")


def is_elevated(risk: Column) -> Column:
    """high or critical."""
    return F.coalesce(risk.isin("high", "critical"), F.lit(False))


def relevance_audit(items: DataFrame, relevant: Column, end: datetime, k: int = 20, hours: int = 24, order: str = "n") -> DataFrame:
    """of the items of the last `hours` hours the newest `k` accepted and the newest `k` rejected ones, with `accepted`, their place `pick`, and how many there are."""
    recent = items.where(F.col("ts").between(F.lit(end - timedelta(hours=hours)), F.lit(end))).withColumn("accepted", relevant)
    w = Window.partitionBy("accepted").orderBy(F.desc("ts"), order)
    counts = F.broadcast(recent.groupBy("accepted").agg(F.count("*").alias("population")))
    return recent.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k).join(counts, "accepted")


def in_viewport(lat: Column, lng: Column, south: float, west: float, north: float, east: float, pad: float = 0.2) -> Column:
    """within the bounds, widened by `pad` of their height and width on each side."""
    dy, dx = (north - south) * pad, (east - west) * pad
    return F.coalesce(lat.between(south - dy, north + dy) & lng.between(west - dx, east + dx), F.lit(False))
