"""Pairs of events that share evidence, and the graph they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconframe.operators.components import connected_components
from beaconframe.operators.near import first_near, key_of, ranked_ends, smallest


def same_entity_pairs(df: DataFrame, least: int = 2, most: int = 40) -> DataFrame:
    """(a, b, entity): pairs of event numbers with an entity that `least` to `most` events have; the cap on frequency is part of the semantics."""
    counts = df.groupBy("entity").agg(F.count("*").alias("df")).where(F.col("df").between(least, most)).select("entity")
    kept = df.select("n", "entity").join(counts, "entity")
    return kept.select("entity", F.col("n").alias("a")).join(kept.select("entity", F.col("n").alias("b")), "entity").where("a < b").select("a", "b", "entity")


def same_incident_pairs(df: DataFrame, days: int = 3) -> DataFrame:
    """(a, b): events of one region and tag, from different sources, `days` days apart at most. Time buckets make the range join an equi-join."""
    width = days * 86400
    bucket = F.floor(F.unix_timestamp("ts") / width)
    left = df.select("region", "tag", F.col("n").alias("a"), F.col("ts").alias("ta"), F.col("source_name").alias("sa"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("t"))
    right = df.select("region", "tag", F.col("n").alias("b"), F.col("ts").alias("tb"), F.col("source_name").alias("sb"), bucket.alias("t"))
    near = F.abs(F.unix_micros("ta") - F.unix_micros("tb")) <= width * 1_000_000
    return left.join(right, ["region", "tag", "t"]).where((F.col("a") < F.col("b")) & (F.col("sa") != F.col("sb")) & near).select("a", "b")


def clusters(pairs: DataFrame) -> DataFrame:
    """(node, component) of the pairs' graph; a component is named by its smallest event."""
    return connected_components(pairs.select("a", "b"))


def neighbours(pairs: DataFrame, k: int = 20) -> DataFrame:
    """Each node's first `k` neighbours by number, both directions."""
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("other"))).where(F.col("rank") <= k)


def strongest_neighbours(edges: DataFrame, k: int = 20, types: list[str] | None = None) -> DataFrame:
    """(node, other, type, weight, rank): each node's `k` edges of the largest weight, of `types` only where given, both directions.

    `edges` has a, b, type and weight. Edges of different types between two
    nodes stay apart; equal weights go by the other node, then the type.
    """
    kept = edges if types is None else edges.where(F.col("type").isin(types))
    ends = lambda x, y: kept.select(F.col(x).alias("node"), F.col(y).alias("other"), "type", "weight")
    both = ends("a", "b").union(ends("b", "a").where("node <> other"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "other", "type"))).where(F.col("rank") <= k)


def first_of_entity(df: DataFrame, k: int) -> DataFrame:
    """(node, others): the `k` smallest numbers of the other events of each event's entity, however many have it. Each event is sent the first of its entity, no pairs are made."""
    rows = df.where("entity is not null").select("entity", "n")
    place = F.row_number().over(Window.partitionBy("entity").orderBy("n"))
    firsts = rows.withColumn("i", place).where(F.col("i") <= k + 1).groupBy("entity").agg(F.collect_list("n").alias("firsts"))
    others = smallest(F.filter("firsts", lambda m: m != F.col("n")), k)
    return rows.join(firsts, "entity").select(F.col("n").alias("node"), others.alias("others"))


def strongest_of_events(df: DataFrame, weight: int = 3, k: int = 20, days: int = 3) -> DataFrame:
    """`strongest_neighbours` of the incidents of `same_incident_pairs`, of `weight`, and of all events of one entity, of weight 1, each event having one. Neither are made, only the first `k` of an event."""
    width = days * 86_400_000_000
    rows = df.where("region is not null and tag is not null and source_name is not null and ts is not null").select(key_of(F.col("region"), F.col("tag")).alias("key"), "n", F.col("source_name").alias("tag"), F.unix_micros("ts").alias("t"), F.lit(0).alias("label"))
    near = first_near(rows, width, k).groupBy(F.col("n").alias("node")).agg(smallest(F.flatten(F.collect_list("others")), k).alias("others"))
    edges = lambda lists, w, type_: lists.select("node", F.transform("others", lambda o: F.struct(F.lit(-w).cast("long").alias("w"), o.alias("other"), F.lit(type_).alias("type"))).alias("ends"))
    both = edges(near, weight, "incident").unionByName(edges(first_of_entity(df, k), 1, "entity")).groupBy("node").agg(F.flatten(F.collect_list("ends")).alias("ends"))
    return ranked_ends(both, k)
