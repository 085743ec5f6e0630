"""The evidence graph: signals, pairs of events with a common cause, edges, clusters and what can be said of them.

Signals are (n, region, category, source_name, ts, keywords, entities, grams, topic), one row per event.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconframe.functions import vocabulary as V
from beaconframe.functions.places import valid_coord
from beaconframe.functions.rules import shingle
from beaconframe.functions.signals import Scanner, text_signals
from beaconframe.operators.components import connected_components
from beaconframe.operators.ranking import ranked
from beaconframe.operators.state import Scratch, materialize

#: Weights of the edges, and the least weight of an incident that joins clusters.
INCIDENT, ENTITY, TOPIC, JOINS = 1.0, 0.6, 0.3, 1.5
_DAY = 86400
_SIGNAL = ("n", "source_name", "keywords", "entities", "grams")
#: Events of a region and three days, as each event finds them on average, up to which J01 tries all their pairs.
CROWD = 64
#: Grams that two events of a vague region must share, and their least share of the smaller title.
VAGUE_GRAMS, VAGUE_SHARE = 8, 0.6


def extract_signals(
    df: DataFrame, lexicon: tuple[tuple[str, str], ...] = V.LEXICON, patterns: tuple[str, ...] = V.ENTITY_PATTERNS, lead: str = V.LEAD_PARTICLES, stop: tuple[str, ...] = V.STOP_BIGRAMS, words: bool = False
) -> DataFrame:
    """C20: the signals of events (n, title, summary, region, category, scope, ts, source_name, source_type, names, topic); `names` are supplied entities.

    Tags and names come from one scan of the whole title and summary, grams from
    the title alone. A null text counts as empty, a missing region is the whole
    country's, a missing scope domestic, a null time stays null; other columns are left out.
    """
    scanner = Scanner([*(p for p, _ in lexicon), *patterns])
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    text, there = F.concat(empty("title"), F.lit(" "), empty("summary")), set(df.columns)
    scanned = df.withColumn("_text", text).withColumn("_hits", scanner.hits(F.col("_text")))
    keywords, entities = text_signals(F.col("_text"), F.col("_hits"), scanner, F.col("names") if "names" in there else None, lexicon, patterns, lead)
    some = lambda c, otherwise: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(otherwise)).alias(c) if c in there else F.lit(otherwise).alias(c)
    return scanned.select(
        "n", some("region", "全國"), some("category", ""), some("scope", "domestic"), "ts", keywords.alias("keywords"), entities.alias("entities"),
        F.array_distinct(shingle(F.col("title"), F.col("region"), stop, words)).alias("grams"), F.trim(empty("topic")).alias("topic") if "topic" in there else F.lit("").alias("topic"), some("source_name", ""), some("source_type", ""),
    )


def _seconds(ts: str) -> Column:
    """A missing time counts as the beginning of time, so such events are near each other."""
    return F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6), F.lit(0.0))


def _near_pairs(signals: DataFrame, keys: list[str], arrays: list[str], days: int, first: bool = False, more: Sequence[str] = ()) -> DataFrame:
    """Pairs, each once, that share the keys and an element of each array and are `days` apart at most; with `first` only those with an event whose `_first` is true.

    Time buckets make it an equi-join, which AQE splits where a key is hot; an
    event is sent to its bucket and the next one, or with `first` one of these
    to three. A pair comes out only where the elements are the smallest common
    ones: what is smaller in one event is not in the other. Either event may be x.
    """
    width = days * _DAY
    own = list(dict.fromkeys([*_SIGNAL, *arrays, *more, *(["_first"] if first else [])]))
    rows = signals.select(*keys, *own, _seconds("ts").alias("_s"))
    on, smaller = [f"_{c}" for c in arrays], [f"_{c}_smaller" for c in arrays]
    for c, one, before in zip(arrays, on, smaller, strict=True):
        rows = rows.withColumn("_a", F.array_sort(F.array_distinct(c))).select("*", F.posexplode("_a").alias("_i", one)).withColumn(before, F.slice("_a", F.lit(1), F.col("_i"))).drop("_a", "_i")
    bucket = F.floor(F.col("_s") / width)
    side = lambda x, b: rows.select(*keys, *on, b.alias("_b"), bucket.alias(f"{x}__b"), *(F.col(c).alias(f"{x}_{c}") for c in [*own, *smaller, "_s"]))
    once = F.col("x_n") < F.col("y_n")
    if first:
        left, once = side("x", F.explode(F.array(bucket - 1, bucket, bucket + 1))).where("x__first"), F.when(F.col("y__first"), once).otherwise(F.col("x_n") != F.col("y_n"))
    else:
        left, once = side("x", F.explode(F.array(bucket, bucket + 1))), (F.col("x__b") < F.col("y__b")) | once
    pairs = left.join(side("y", bucket), [*keys, *on, "_b"]).where(once & (F.abs(F.col("x__s") - F.col("y__s")) <= width))
    for c in smaller:
        pairs = pairs.where(~F.arrays_overlap(f"x_{c}", f"y_{c}"))
    return pairs.select(*keys, *(f"{x}_{c}" for x in "xy" for c in own))


def _crowded(signals: DataFrame, keys: list[str], days: int) -> bool:
    groups = signals.groupBy(*keys, F.floor(_seconds("ts") / (days * _DAY))).agg(F.count("*").alias("k"))
    pairs, n = groups.agg(F.sum(F.col("k").cast("double") * F.col("k")), F.sum("k")).first()
    return bool(n) and pairs > CROWD * n


def _near_blocks(signals: DataFrame, keys: list[str], days: int, first: bool = False) -> DataFrame:
    """Pairs as of `_near_pairs` that share the keys and a keyword, from all pairs of a block of time and the next one: each event is sent to three places, however many tokens it has. Either event may be x."""
    width, own = days * _DAY, [*_SIGNAL, *(["_first"] if first else [])]
    rows = signals.select(*keys, *own, _seconds("ts").alias("_s"))
    bucket = F.floor(F.col("_s") / width)
    side = lambda x, b: rows.select(*keys, b.alias("_b"), bucket.alias(f"{x}__b"), *(F.col(c).alias(f"{x}_{c}") for c in [*own, "_s"]))
    both = side("x", F.explode(F.array(bucket, bucket + 1))).join(side("y", bucket), [*keys, "_b"])
    once = (F.col("x__b") < F.col("y__b")) | (F.col("x_n") < F.col("y_n"))
    some = once & (F.abs(F.col("x__s") - F.col("y__s")) <= width) & F.arrays_overlap("x_keywords", "y_keywords")
    return both.where(some & (F.col("x__first") | F.col("y__first")) if first else some).select(*keys, *(f"{x}_{c}" for x in "xy" for c in own))


def _rare_grams(signals: DataFrame) -> DataFrame:
    """(n, rare): each event's grams but for its VAGUE_GRAMS - 1 most frequent ones. Two events with VAGUE_GRAMS common grams share one of them."""
    grams = signals.select("n", F.explode(F.array_distinct("grams")).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("k"))
    order = F.array_sort(F.collect_list(F.struct("k", "gram")))
    return grams.join(often, "gram").groupBy("n").agg(order.alias("g")).where(F.size("g") >= VAGUE_GRAMS).select("n", F.transform(F.slice("g", F.lit(1), F.size("g") - (VAGUE_GRAMS - 1)), lambda x: x["gram"]).alias("rare"))


def incident_candidates(signals: DataFrame, days: int = 3, vague: tuple[str, ...] = V.VAGUE_REGIONS, first: bool = False) -> DataFrame:
    """Pairs of events of one region, near in time, with a common keyword and a common entity or gram; in a vague region with a common entity or a common rare gram.

    There an event is indexed by its entities and its rarest grams only (prefix
    filter on the order of the grams' frequencies), so what all titles share makes no pairs.
    """
    is_vague = F.col("region").isin(*vague)
    tagged = lambda c, tag: F.transform(c, lambda x: F.concat(F.lit(tag), x))
    entities = tagged("entities", "e")
    signals = signals.withColumn("tokens", F.concat(tagged("keywords", "k"), entities, tagged("grams", "g")))
    near = signals.where(~is_vague).withColumn("index", F.array_union(entities, tagged("grams", "g")))
    far = signals.where(is_vague)
    far = far.join(_rare_grams(far), "n", "left").withColumn("index", F.array_union(entities, tagged(F.coalesce("rare", F.array().cast("array<string>")), "g"))).drop("rare")
    return _near_pairs(near.unionByName(far), ["region"], ["keywords", "index"], days, first, ["tokens"])


def same_incident(signals: DataFrame, days: int = 3, vague: tuple[str, ...] = V.VAGUE_REGIONS, first: bool = False) -> DataFrame:
    """(a, b, type, weight, why, entity): one region, different sources, a common keyword and a common entity or gram.

    In a vague region it takes a common entity, or eight grams that are 60 % of
    the smaller title. The weight grows with the number of all that is common, up to five.
    With `first` only those with an event whose `_first` is true. Where few
    events are near each other in time their pairs are tried; else tokens find them.
    """
    crowded = _crowded(signals, ["region"], days)
    found = incident_candidates(signals, days, vague, first) if crowded else _near_blocks(signals, ["region"], days, first)
    return incidents_of(found.where("x_source_name <> y_source_name"), vague, crowded)


def incidents_of(found: DataFrame, vague: tuple[str, ...] = V.VAGUE_REGIONS, met: bool = False) -> DataFrame:
    """Which of the pairs (region, and x_ and y_ of _SIGNAL) of different sources that are near in time and share a keyword are incidents. `met` says that all share an entity or gram too, and that the pairs have `tokens`, all of an event in one array."""
    common = lambda c: F.size(F.array_intersect(f"x_{c}", f"y_{c}"))
    kw, ent, grams = common("keywords"), common("entities"), common("grams")
    share = grams / F.greatest(F.lit(1), F.least(F.size(F.array_distinct("x_grams")), F.size(F.array_distinct("y_grams"))))
    strong = (ent >= 1) | ((grams >= VAGUE_GRAMS) & (share >= VAGUE_SHARE))
    score = common("tokens") if met else kw + ent + grams
    ok = F.when(F.col("region").isin(*vague), strong).otherwise(F.lit(True) if met else (ent + grams >= 1) & (score >= 2))
    return found.where(ok).select(F.least("x_n", "y_n").alias("a"), F.greatest("x_n", "y_n").alias("b"), F.lit("same-incident").alias("type"), (INCIDENT + F.least(score, F.lit(5)) * 0.1).alias("weight"), F.lit("跨源佐證：同地、案類與用詞重疊、時間相近").alias("why"), F.lit(None).cast("string").alias("entity"))


def same_topic(signals: DataFrame, days: int = 2, vague: tuple[str, ...] = V.VAGUE_REGIONS, first: bool = False) -> DataFrame:
    """One region that is not vague, one source, one category, a common keyword; with `first` only pairs with an event whose `_first` is true."""
    some = signals.where(~F.col("region").isin(*vague) & (F.coalesce(F.col("category"), F.lit("")) != ""))
    some = some.select("n", "region", "category", F.col("source_name").alias("source"), "source_name", "ts", "keywords", *(F.array().cast("array<string>").alias(c) for c in ("entities", "grams")), *(["_first"] if first else []))
    return topics_of(_near_pairs(some, ["region", "source", "category"], ["keywords"], days, first))


def topics_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x_n", "y_n").alias("a"), F.greatest("x_n", "y_n").alias("b"), F.lit("same-topic").alias("type"), F.lit(TOPIC).alias("weight"), F.lit("同地同類相關情勢").alias("why"), F.lit(None).cast("string").alias("entity"))


def _groups(rows: DataFrame, key: str, least: int, most: int) -> DataFrame:
    return rows.join(rows.groupBy(key).agg(F.count("*").alias("_k")).where(F.col("_k").between(least, most)).select(key), key)


def same_entity(signals: DataFrame, most: int = 40) -> DataFrame:
    """Events with a common entity that 2 to `most` events have; the cap on its frequency is part of the semantics."""
    kept = _groups(signals.select("n", F.explode(F.array_distinct("entities")).alias("entity")), "entity", 2, most)
    pairs = kept.select("entity", F.col("n").alias("a")).join(kept.select("entity", F.col("n").alias("b")), "entity").where("a < b")
    return pairs.select("a", "b", F.lit("same-entity").alias("type"), F.lit(ENTITY).alias("weight"), F.concat(F.lit("共享實體「"), "entity", F.lit("」")).alias("why"), "entity")


def skipped_entities(signals: DataFrame, most: int = 40) -> DataFrame:
    """How many entities were passed over because more than `most` events have them."""
    return signals.select(F.explode(F.array_distinct("entities")).alias("entity")).groupBy("entity").count().where(F.col("count") > most).agg(F.count("*").alias("skipped"))


def same_story(signals: DataFrame, most: int = 40) -> DataFrame:
    """Events of one topic of four letters or more that 2 to `most` events have: an incident from different sources, a topic from one."""
    rows = signals.select("n", "source_name", F.trim("topic").alias("topic")).where(F.length("topic") >= 4)
    kept = _groups(rows, "topic", 2, most)
    side = lambda n, s: kept.select("topic", F.col("n").alias(n), F.col("source_name").alias(s))
    differ = F.coalesce(F.col("sa"), F.lit("")) != F.coalesce(F.col("sb"), F.lit(""))
    return side("a", "sa").join(side("b", "sb"), "topic").where("a < b").select(
        "a", "b", F.when(differ, "same-incident").otherwise("same-topic").alias("type"), F.when(differ, INCIDENT + 0.2).otherwise(TOPIC + 0.1).alias("weight"), F.concat(F.lit("AI 同題："), "topic").alias("why"), F.lit(None).cast("string").alias("entity")
    )


def merge_edges(*passes: DataFrame, why: bool = True) -> DataFrame:
    """One edge of each pair: the greatest weight; of equal weights the first pass's type, and all reasons in order of pass and text, which are left out without `why`."""
    every = None
    for i, p in enumerate(passes):
        p = p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(i).alias("pass"), "type", "weight", "why", "entity").where("a <> b")
        every = p if every is None else every.union(p)
    if not why:
        top = F.min(F.struct((-F.col("weight")).alias("w"), "pass", "entity", "type")).alias("r")
        return every.groupBy("a", "b").agg(top).select("a", "b", "r.type", (-F.col("r.w")).alias("weight"), "r.entity")
    best = every.groupBy("a", "b").agg(F.max("weight").alias("weight"), F.collect_list(F.struct("pass", "entity", "why", "type", "weight")).alias("r"))
    top = F.array_sort(F.filter("r", lambda x: x["weight"] == F.col("weight")))
    return best.withColumn("r", top).select("a", "b", F.col("r")[0]["type"].alias("type"), "weight", F.array_join(F.array_distinct(F.transform("r", lambda x: x["why"])), "；").alias("why"), F.col("r")[0]["entity"].alias("entity"))


def union_edges(edges: DataFrame, blocked: tuple[str, ...] = V.ENTITY_BLOCKLIST) -> DataFrame:
    """The edges that join clusters: entities whose first one is not blocked, and incidents of weight 1.5 or more."""
    entity = (F.col("type") == "same-entity") & ~F.coalesce(F.col("entity").isin(*blocked), F.lit(False))
    return edges.where(entity | ((F.col("type") == "same-incident") & (F.col("weight") >= JOINS - 1e-9)))


def clusters(edges: DataFrame, blocked: tuple[str, ...] = V.ENTITY_BLOCKLIST) -> DataFrame:
    """(n, cluster) of the clusters of two events or more; a cluster is named by its smallest event."""
    return connected_components(union_edges(edges, blocked)).select(F.col("node").alias("n"), F.col("component").alias("cluster"))


def all_edges(signals: DataFrame, vague: tuple[str, ...] = V.VAGUE_REGIONS, why: bool = True) -> DataFrame:
    """G01 of J01 to J04."""
    return merge_edges(same_incident(signals, vague=vague).union(same_topic(signals, vague=vague)), same_entity(signals), same_story(signals), why=why)


def correlate(signals: DataFrame, blocked: tuple[str, ...] = V.ENTITY_BLOCKLIST, vague: tuple[str, ...] = V.VAGUE_REGIONS, table: Scratch | None = None, why: bool = True) -> tuple[DataFrame, DataFrame]:
    """(edges, clusters) of one scope's signals: all pairs, merged, and their components.

    Signals and edges are written once, among the tables of the job `table` if
    that is given, so that no pass derives them anew.
    """
    keep = table or materialize
    edges = keep(all_edges(keep(signals, "signals"), vague, why), "edges")
    return edges, clusters(edges, blocked)


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, type, weight) of each edge in both directions."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "type", "weight").union(edges.select("b", "a", "type", "weight"))


def strongest(edges: DataFrame, k: int = 20, types: list[str] | None = None) -> DataFrame:
    """Each event's `k` neighbours of the greatest weight with their rank; ties by number and type."""
    some = both_ways(edges if types is None else edges.where(F.col("type").isin(types)))
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "other", "type"))).where(F.col("rank") <= k)


def node_stats(signals: DataFrame, edges: DataFrame) -> DataFrame:
    """(n, degree, sources): number of edges, and the other sources that report an incident with it, sorted."""
    ends = both_ways(edges)
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    named = signals.select(F.col("n"), F.col("source_name"))
    told = ends.where("type = 'same-incident'").join(named.select(F.col("n").alias("other"), F.col("source_name").alias("so")), "other").join(named.select(F.col("n").alias("node"), F.col("source_name").alias("sn")), "node").where("so <> sn")
    sources = told.groupBy("node").agg(F.array_sort(F.collect_set("so")).alias("sources"))
    return joined_stats(signals, degree, sources)


def joined_stats(signals: DataFrame, degree: DataFrame, sources: DataFrame) -> DataFrame:
    """A20 of all events from the degree and the sorted sources of some (node)."""
    return signals.select(F.col("n").alias("node")).join(degree, "node", "left").join(sources, "node", "left").select(F.col("node").alias("n"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def corroboration(signals: DataFrame, edges: DataFrame) -> DataFrame:
    """(n, sources, confirmed): distinct sources of an event and its incident neighbours; confirmed from two on."""
    own = signals.select("n", "source_name")
    others = both_ways(edges.where("type = 'same-incident'")).join(own.select(F.col("n").alias("other"), "source_name"), "other").select(F.col("node").alias("n"), "source_name")
    return confirmed(own.union(others))


def confirmed(told: DataFrame) -> DataFrame:
    """A19 of (n, source_name), an event's own source and those of its neighbours."""
    return told.groupBy("n").agg(F.count_distinct("source_name").alias("sources")).withColumn("confirmed", F.col("sources") >= 2)


def incident_members(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster, n): the members with an incident within their cluster."""
    inside = edges.where("type = 'same-incident'").join(members.select(F.col("n").alias("a"), F.col("cluster").alias("ca")), "a").join(members.select(F.col("n").alias("b"), F.col("cluster").alias("cb")), "b").where("ca = cb")
    return inside.select(F.col("ca").alias("cluster"), F.explode(F.array("a", "b")).alias("n")).distinct()


def cluster_profile(members: DataFrame, signals: DataFrame, evidence: DataFrame | None = None, share: float = 0.5, entropy: float = 1.5, topics: float = 0.4) -> DataFrame:
    """A17 with the members (cluster, n) that have direct evidence, as `incident_members` gives; without them `evidence` is left out: what a cluster is: size, first category and two regions by number (ties by name), latest time, sources with direct evidence, dominance and entropy of categories, distinct topics, span in days, and whether it is incoherent."""
    m = members.join(signals.select("n", "category", "region", "source_name", "ts", "topic"), "n")
    base = m.groupBy("cluster").agg(F.count("*").alias("size"), F.max("ts").alias("latest"), F.min("ts").alias("earliest"), F.count_distinct(F.nullif(F.trim("topic"), F.lit(""))).alias("_topics"))
    by_category = m.where("category <> ''").groupBy("cluster", "category").agg(F.count("*").alias("k")).join(base.select("cluster", "size"), "cluster")
    p = F.col("k") / F.col("size")
    spread = by_category.groupBy("cluster").agg(F.max(p).alias("dominant_share"), (-F.sum(p * F.log2(p))).alias("entropy"), F.min_by("category", F.struct(-F.col("k"), "category")).alias("category"))
    regions = m.where("region <> ''").groupBy("cluster", "region").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "region"))), 1, 2).alias("r"))
    ratio = F.col("_topics") / F.col("size")
    span = F.coalesce((F.unix_micros(F.col("latest").cast("timestamp")) - F.unix_micros(F.col("earliest").cast("timestamp"))) / F.lit(86_400_000_000), F.lit(0.0))
    out = base.join(spread, "cluster", "left").join(regions, "cluster", "left").withColumn("topic_ratio", ratio).withColumn("span_days", span)
    if evidence is not None:
        sources = evidence.join(signals.select("n", "source_name"), "n").groupBy("cluster").agg(F.array_sort(F.collect_set("source_name")).alias("evidence"))
        out = out.join(sources, "cluster", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    low = (F.coalesce("dominant_share", F.lit(0.0)) < share) | ((F.coalesce("entropy", F.lit(0.0)) >= entropy) & (F.col("topic_ratio") >= topics))
    return out.select("cluster", "size", "category", F.transform("r", lambda x: x["region"]).alias("regions"), "latest", *(["evidence"] if evidence is not None else []), F.coalesce("dominant_share", F.lit(0.0)).alias("dominant_share"), F.coalesce("entropy", F.lit(0.0)).alias("entropy"), "topic_ratio", "span_days", low.alias("incoherent"))


def cluster_series(members: DataFrame, signals: DataFrame, evidence: DataFrame) -> DataFrame:
    """(cluster, day, reports, sources): each cluster's reports by day, and the distinct sources of those in `evidence` (n). Events without a time are left out; `missing_times` has them."""
    m = members.join(signals.select("n", "ts", "source_name"), "n").where("ts is not null").join(evidence.select("n", F.lit(True).alias("_direct")).distinct(), "n", "left")
    return m.groupBy("cluster", F.to_date("ts").alias("day")).agg(F.count("*").alias("reports"), F.count_distinct(F.when(F.col("_direct"), F.col("source_name"))).alias("sources"))


def missing_times(members: DataFrame, signals: DataFrame) -> DataFrame:
    """The members without a time."""
    return members.join(signals.where("ts is null").select("n"), "n")


def _cells(lat: Column, lng: Column, km: float) -> list[Column]:
    """The cube of side `km` that a place lies in; places `km` apart at most, whose chord is shorter still, lie in the same or in neighbouring cubes, also at a pole or at 180 degrees."""
    r, a, b = 6371.0088 / km, F.radians(lat), F.radians(lng)
    return [F.floor(x * r).cast("long") for x in (F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))]


def geo_star_clusters(df: DataFrame, group: str, km: float = 15.0, most: int = 5_000_000) -> DataFrame:
    """(group, n, geo, size, centroid_lat, centroid_lng): star clusters of located events within each group.

    Points in order of latitude and longitude; each one that is still free
    gathers the free ones within `km`. What a point gathers lies in its cube of
    side `km` or in a neighbouring one, so the stars of one component of
    neighbouring cubes do not depend on other components: each is one task's
    group, of distinct coordinates only, and one of more than `most` of them is
    refused. `geo` numbers the stars of a group by their first points. Events
    without valid coordinates are left out. Centroids have five decimals.
    """
    with Scratch(df.sparkSession) as table:
        there = table(df.where(valid_coord(F.col("lat"), F.col("lng"))).select(group, "n", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")), "there")
        x, y, z = _cells(F.col("lat"), F.col("lng"), km)
        points = table(there.groupBy(group, "lat", "lng").agg(F.count("*").alias("k")).withColumns({"x": x, "y": y, "z": z}), "points")
        name = lambda dx, dy, dz: F.xxhash64(group, F.col("x") + dx, F.col("y") + dy, F.col("z") + dz)  # noqa: E731  equal names of two cubes only join components
        cells = table(points.select(group, "x", "y", "z", name(0, 0, 0).alias("cell")).distinct(), "cells")
        steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]
        beside = cells.select(F.col("cell").alias("a"), F.explode(F.array(*(name(*s) for s in steps))).alias("b")).join(cells.select(F.col("cell").alias("b")), "b", "left_semi")
        part = connected_components(beside, table=table)
        points = points.withColumn("cell", name(0, 0, 0)).join(part.select(F.col("node").alias("cell"), "component"), "cell", "left").withColumn("component", F.coalesce("component", "cell"))
        largest = points.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if largest and largest > most:
            raise ValueError(f"{largest} distinct places lie within {km} km of each other in a chain; the most is {most}")
        kind = dict(df.dtypes)[group]
        # A place alone is its own star; only components of several places are worth a task's Python group.
        points = points.select(group, "component", "lat", "lng", "k", F.count("*").over(Window.partitionBy(group, "component")).alias("_places"))
        rounded = lambda c: (F.floor(F.col("k") * F.col(c) / F.col("k") * 1e5 + 0.5) / 1e5).alias(f"centroid_{c}")
        alone = points.where("_places = 1").select(group, "lat", "lng", F.col("lat").alias("seed_lat"), F.col("lng").alias("seed_lng"), F.col("k").alias("size"), rounded("lat"), rounded("lng"))
        stars = points.where("_places > 1").drop("_places").groupBy(group, "component").applyInPandas(_stars(group, km), f"{group} {kind}, lat double, lng double, seed_lat double, seed_lng double, size long, centroid_lat double, centroid_lng double")
        stars = table(alone.union(stars), "stars")
        numbered = ranked(stars.select(group, "seed_lat", "seed_lng").distinct(), [group], [F.col("seed_lat"), F.col("seed_lng")], "geo", table=table)
        stars = stars.join(numbered, stars[group].eqNullSafe(numbered[group]) & (stars["seed_lat"] == numbered["seed_lat"]) & (stars["seed_lng"] == numbered["seed_lng"])).select(stars["*"], (F.col("geo") - 1).cast("int").alias("geo"))
        out = there.join(stars, there[group].eqNullSafe(stars[group]) & (there["lat"] == stars["lat"]) & (there["lng"] == stars["lng"]))
        return materialize(out.select(there[group], "n", "geo", "size", "centroid_lat", "centroid_lng"), "geo")


def _stars(group: str, km: float):
    """Stars of one component: each free point in order looks at the later ones within its reach of latitude; all earlier ones are taken."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lat", "lng"]).reset_index(drop=True)
        lat, lng, k = np.radians(pdf["lat"].to_numpy()), np.radians(pdf["lng"].to_numpy()), pdf["k"].to_numpy()
        ends = np.searchsorted(lat, lat + km / 6371.0088 * (1 + 1e-9) + 1e-12, side="right")
        star, count = np.full(len(pdf), -1), 0
        first = []
        for i in range(len(pdf)):
            if star[i] < 0:
                free = i + np.flatnonzero(star[i : ends[i]] < 0)
                h = np.sin((lat[free] - lat[i]) / 2) ** 2 + np.cos(lat[free]) * np.cos(lat[i]) * np.sin((lng[free] - lng[i]) / 2) ** 2
                star[free[2 * 6371.0088 * np.arcsin(np.sqrt(h)) <= km]] = count
                first.append(i)
                count += 1
        size = np.bincount(star, k, count)
        out = pdf[[group, "lat", "lng"]].copy()
        for c in ("lat", "lng"):
            values = pdf[c].to_numpy()
            out[f"seed_{c}"] = values[first][star]
            out[f"centroid_{c}"] = (np.floor(np.bincount(star, k * values, count) / size * 1e5 + 0.5) / 1e5)[star]
        out["size"] = size[star].astype("int64")
        return out[[group, "lat", "lng", "seed_lat", "seed_lng", "size", "centroid_lat", "centroid_lng"]]

    return gather


def cluster_signals(members: DataFrame, located: DataFrame, signals: DataFrame, evidence: DataFrame, km: float = 15.0) -> DataFrame:
    """(cluster, days, first_day, last_day, geo_clusters, without_place): a cluster's series and places in one row."""
    series = cluster_series(members, signals, evidence).groupBy("cluster").agg(F.count("*").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    placed = members.join(located.select("n", "lat", "lng"), "n")
    geo = geo_star_clusters(placed, "cluster", km).groupBy("cluster").agg(F.count_distinct("geo").alias("geo_clusters"))
    without = placed.groupBy("cluster").agg(F.count_if(~valid_coord(F.col("lat"), F.col("lng"))).alias("without_place"))
    return without.join(series, "cluster", "left").join(geo, "cluster", "left").select("cluster", F.coalesce("days", F.lit(0)).alias("days"), "first_day", "last_day", F.coalesce("geo_clusters", F.lit(0)).alias("geo_clusters"), "without_place")


def cluster_hub(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster, hub): the member with most edges; ties to the smaller one."""
    degree = both_ways(edges).groupBy(F.col("node").alias("n")).agg(F.count("*").alias("k"))
    return hubs(members, degree)


def hubs(members: DataFrame, degree: DataFrame) -> DataFrame:
    """G07 from the number of edges `k` of each event that has any."""
    return members.join(degree, "n", "left").groupBy("cluster").agg(F.min_by("n", F.struct(-F.coalesce("k", F.lit(0)), "n")).alias("hub"))


def graph_stats(signals: DataFrame, edges: DataFrame, members: DataFrame, blocked: tuple[str, ...] = V.ENTITY_BLOCKLIST) -> DataFrame:
    """Events, edges by type, clusters, the largest one, entities and entity edges passed over, in one row."""
    e = edges.agg(F.count("*").alias("edges"), *(F.count_if(F.col("type") == t).alias(t.replace("-", "_")) for t in ("same-incident", "same-entity", "same-topic")), F.count_if((F.col("type") == "same-entity") & F.coalesce(F.col("entity").isin(*blocked), F.lit(False))).alias("skipped_union"))
    c = members.groupBy("cluster").count().agg(F.count("*").alias("clusters"), F.coalesce(F.max("count"), F.lit(0)).alias("largest"))
    return signals.agg(F.count("*").alias("events")).join(e).join(c).join(skipped_entities(signals))


def collapse(df: DataFrame, edges: DataFrame, order: str = "n") -> DataFrame:
    """(n, group, place, members, sources): events joined by incidents within `df` alone.

    A group's first member is the gravest, then newest, then first event and
    gives the group its number; the others follow by time. Single events are groups of one.
    """
    inside = edges.where("type = 'same-incident'").join(df.select(F.col("n").alias("a")), "a", "left_semi").join(df.select(F.col("n").alias("b")), "b", "left_semi")
    part = connected_components(inside).select(F.col("node").alias("n"), F.col("component").alias("_c"))
    rows = df.join(part, "n", "left").withColumn("_c", F.coalesce("_c", "n"))
    first = Window.partitionBy("_c").orderBy(F.desc("risk_rank"), F.desc_nulls_last("ts"), order)
    ranked = rows.withColumn("_first", F.row_number().over(first) == 1)
    place = Window.partitionBy("_c").orderBy(F.desc("_first"), F.desc_nulls_last("ts"), order)
    stats = rows.groupBy("_c").agg(F.count("*").alias("members"), F.count_distinct("source_name").alias("sources"))
    head = ranked.where("_first").select("_c", F.col("n").alias("group"))
    return ranked.withColumn("place", F.row_number().over(place)).join(stats, "_c").join(head, "_c").select("n", "group", "place", "members", "sources")


def text_search(df: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows that hold the query in one of the fields, whatever the case; a blank query keeps all."""
    wanted = query.strip().lower()
    return df if not wanted else df.where(F.contains(F.lower(F.concat_ws("\x1f", *fields)), F.lit(wanted)))


def search_subnet(df: DataFrame, edges: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows of `df` that match the query, and their neighbours within `df`."""
    hits = text_search(df, query, fields).select("n")
    near = both_ways(edges).join(hits.select(F.col("n").alias("node")), "node", "left_semi").select(F.col("other").alias("n"))
    return df.join(hits.union(near).distinct(), "n", "left_semi")


def two_hop(edges: DataFrame, shown: DataFrame, k: int = 5) -> DataFrame:
    """For each (center, node) of `shown`, the `k` strongest neighbours of the node that are neither the center nor shown with it."""
    return two_hop_of(both_ways(edges), shown, k)


def two_hop_of(ends: DataFrame, shown: DataFrame, k: int = 5) -> DataFrame:
    """J15 from the edges (node, other, weight) of each node that is shown."""
    next_ = shown.join(ends, "node").where("other <> center").groupBy("center", "node", "other").agg(F.max("weight").alias("weight"))
    fresh = next_.join(shown.select("center", F.col("node").alias("other")), ["center", "other"], "left_anti")
    w = Window.partitionBy("center", "node").orderBy(F.desc("weight"), "other")
    return fresh.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cluster_members(members: DataFrame, df: DataFrame, cluster: Column) -> DataFrame:
    """The events of the clusters that meet a condition, newest first."""
    return df.join(members.where(cluster).select("n", "cluster"), "n").orderBy(F.desc_nulls_last("ts"), "n")


def top_clusters(profiles: DataFrame, k: int = 5) -> DataFrame:
    """Coherent ones first, then by size times dominance, size, latest time and name."""
    return profiles.orderBy("incoherent", F.desc(F.round(F.col("size") * F.col("dominant_share"), 9)), F.desc("size"), F.desc_nulls_last("latest"), "cluster").limit(k)


def clusters_to_summarise(profiles: DataFrame, members: DataFrame, df: DataFrame, k: int = 8, most: int = 16) -> DataFrame:
    """(cluster, n, place): of the `k` largest coherent clusters the first `most` members in brief order."""
    top = profiles.where(~F.col("incoherent") & (F.col("size") >= 2)).orderBy(F.desc("size"), "cluster").limit(k).select("cluster")
    w = Window.partitionBy("cluster").orderBy(F.desc_nulls_last("risk_rank"), F.desc_nulls_last("ts"), "n")
    return members.join(F.broadcast(top), "cluster", "left_semi").join(df.select("n", "risk_rank", "ts"), "n").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("cluster", "n", "place")
