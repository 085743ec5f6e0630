"""Numbers, sources and clusters of the graph without its pairs, against the pairs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from beaconframe.operators import graph, links
from beaconframe.operators.components import connected_components

SIGNAL = "n long, region string, category string, source_name string, ts timestamp, keywords array<string>, entities array<string>, grams array<string>, topic string"
VAGUE = ("V",)


def _signals(spark, seed, n=160):
    """Most events have few tokens, some have many; some have no time, region or source."""
    r = random.Random(seed)
    pick = lambda tag, kinds, most: [f"{tag}{r.randrange(kinds)}" for _ in range(r.randint(0, most))]
    rows = [
        (
            i, r.choice(["A", "A", "B", "V", None]), r.choice(["c", "d", ""]), r.choice(["s", "t", "u", None]), r.choice([None, *(datetime(2026, 6, 20) + timedelta(hours=12 * r.randrange(20)) for _ in range(9))]),
            pick("k", 3, 2), pick("e", 30, 1), pick("g", 9, r.choice([2, 2, 2, 14])), f"topic{r.randrange(40)}",
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SIGNAL).localCheckpoint()


def _set(df):
    return set(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1])
def test_numbers_sources_and_joins_equal_those_of_all_pairs(spark, seed):
    s = _signals(spark, seed)
    incidents, edges = graph.same_incident(s, vague=VAGUE).localCheckpoint(), graph.all_edges(s, VAGUE).localCheckpoint()
    ends = lambda df, *c: df.select(F.col("a").alias("n"), *c).union(df.select("b", *c))
    score = F.round((F.col("weight") - 1) * 10).cast("int").alias("score")
    want = _set(ends(incidents, score).groupBy("n", "score").count())
    assert _set(links.incident_counts(s, vague=VAGUE)) == want and {x[1] for x in want} == {2, 3, 4, 5}
    assert dict(links.incident_counts(s, vague=VAGUE).dtypes)["links"] == "bigint"
    assert _set(links.topic_counts(s, vague=VAGUE)) == _set(ends(graph.same_topic(s, vague=VAGUE)).groupBy("n").count())
    types = [F.count_if(F.col("type") == t) for t in ("same-incident", "same-entity", "same-topic")]
    assert _set(links.edge_counts(s, VAGUE)) == _set(ends(edges, "type").groupBy("n").agg(*types))
    assert _set(links.node_stats(s, links.close_edges(s, VAGUE), VAGUE).withColumn("sources", F.array_join("sources", ","))) == _set(graph.node_stats(s, edges).withColumn("sources", F.array_join("sources", ",")))
    assert _set(links.corroboration(s, VAGUE)) == _set(graph.corroboration(s, edges))
    members = graph.clusters(edges, ("e1",))
    assert _set(links.clusters(s, ("e1",), VAGUE)) == _set(members)
    assert _set(links.cluster_evidence(members, s, VAGUE)) == _set(graph.incident_members(members, edges))
    for least in (2, 3, 4, 5):
        heavy = incidents.where(F.col("weight") >= 1 + 0.1 * least - 1e-9)
        assert _set(connected_components(links.incident_links(s, least, vague=VAGUE))) == _set(connected_components(heavy))
    hits = s.where("n % 9 = 0").select("n")
    near = graph.both_ways(edges).join(hits.select(F.col("n").alias("node")), "node", "left_semi").select("other")
    assert _set(links.neighbours(s, hits, VAGUE)) == _set(hits.union(near).distinct())


def test_links_of_one_crowded_day_grow_with_its_events(spark):
    rows = [(i, "A", "c", f"s{i % 3}", datetime(2026, 6, 20) + timedelta(seconds=i), ["k"], [], ["g", "h"], "") for i in range(2000)]
    s = spark.createDataFrame(rows, SIGNAL)
    assert links.incident_links(s, 3).count() < 4000
    assert _set(links.incident_counts(s).groupBy("score").agg(F.sum("links"))) == {(3, 2000 * 2000 - 2 * 667**2 - 666**2)}


def test_pairs_by_blocks_of_time_equal_those_by_tokens(spark, monkeypatch):
    s, kept = _signals(spark, 3), ("a", "b", "type", "entity", F.round("weight", 6))
    by_blocks = _set(graph.all_edges(s, VAGUE, why=False).select(*kept))
    monkeypatch.setattr(graph, "CROWD", 0)
    assert _set(graph.all_edges(s, VAGUE).select(*kept)) == by_blocks and by_blocks


def test_long_texts_near_few_others_are_not_sent_by_token(spark):
    rows = [(i, "A", "c", f"s{i % 3}", datetime(2026, 6, 20) + timedelta(days=i), ["k", "l"], [], [f"g{j}" for j in range(500)], "") for i in range(8)]
    plan = graph.same_incident(spark.createDataFrame(rows, SIGNAL))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1


def test_a_place_alone_needs_no_python_group(spark, monkeypatch):
    def refuse(pdf):
        raise AssertionError("a group of one place")

    rows = [(f"c{i}", i, 20.0 + i / 7, 100.0) for i in range(9)] + [("c0", 9, 20.0, 100.0)]
    df = spark.createDataFrame(rows, "cluster string, n long, lat double, lng double")
    want = _set(graph.geo_star_clusters(df, "cluster"))
    monkeypatch.setattr(graph, "_stars", lambda *_: refuse)
    assert _set(graph.geo_star_clusters(df, "cluster")) == want and {(r[1], r[3]) for r in want if r[0] == "c0"} == {(0, 2), (9, 2)}
