"""The first others near in time, and the strongest neighbours made of them, against all pairs."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from beaconframe.operators import evidence, graph, links
from beaconframe.operators.near import first_near
from beaconframe.plans.bindings import events
from tests.test_links import VAGUE, _signals

SMALLEST = "/root/testdata/sf0.001"


def _refuse(*_, **__):
    raise AssertionError("all pairs are made")


def _set(df):
    return set(map(tuple, df.collect()))


def test_first_near_equals_all_pairs(spark):
    r = random.Random(5)
    for k, width, order in ((1, 9, 1), (3, 40, -1), (3, 40, 1)):
        rows = [(r.choice("ab"), order * i, r.choice(["s", "s", "s", "t", "u"]), i // 2 + r.randrange(3), r.choice([7, None])) for i in range(300)]
        got = {}
        for n, label, others in first_near(spark.createDataFrame(rows, "key string, n long, tag string, t long, label int"), width, k).collect():
            assert label == 7 and len(others) <= k
            got[n] = got.get(n, []) + others
        want = {n: sorted(m for q, m, x, u, _ in rows if q == key and x != tag and abs(t - u) <= width)[:k] for key, n, tag, t, label in rows if label}
        assert {n: sorted(x)[:k] for n, x in got.items()} == {n: x for n, x in want.items() if x}


def test_strongest_of_events_makes_no_pairs(spark, monkeypatch):
    e = events(spark, SMALLEST)
    entity = evidence.same_entity_pairs(e).select("a", "b", F.lit("entity").alias("type"), F.lit(1).cast("long").alias("weight"))
    want = _set(evidence.strongest_neighbours(evidence.same_incident_pairs(e).select("a", "b", F.lit("incident"), F.lit(3).cast("long")).union(entity).toDF("a", "b", "type", "weight")))
    monkeypatch.setattr(evidence, "same_incident_pairs", _refuse)
    assert _set(entry.queries()["j13_strongest"](spark, SMALLEST)) == want and want


def test_strongest_of_signals_equals_that_of_all_edges(spark):
    s = _signals(spark, 2)
    edges, close = graph.all_edges(s, VAGUE).withColumn("weight", F.round("weight", 6)).localCheckpoint(), links.close_edges(s, VAGUE).localCheckpoint()
    for k in (2, 20):
        want = _set(graph.strongest(edges, k))
        assert _set(links.strongest(s, close, k, VAGUE)) == want and len({x[2] for x in want}) == 3
    shown = graph.both_ways(edges).where("type = 'same-entity' and node % 2 = 0").select(F.col("node").alias("center"), F.col("other").alias("node")).distinct()
    assert _set(links.two_hop(s, close, shown, 3, VAGUE)) == _set(graph.two_hop(edges, shown, 3))


def test_queries_of_strongest_neighbours_make_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "same_incident", _refuse)
    monkeypatch.setattr(graph, "same_topic", _refuse)
    for name in ("j13_by_weight", "j15_two_hop"):
        assert entry.queries()[name](spark, SMALLEST).count()
