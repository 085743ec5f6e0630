"""Signals, pairs, stars and ranks against plain loops."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconframe.functions import rules, signals
from beaconframe.functions import vocabulary as V
from beaconframe.operators import graph, ranking

EVENT = "n long, region string, category string, ts timestamp, title string, summary string, source_name string, names array<string>, topic string"
DAY = datetime(2026, 6, 20, 10)


def _event(n, title, region="臺北市", category="治安", hours=0, source=None, summary="", names=None, topic=None):
    return (n, region, category, DAY + timedelta(hours=hours), title, summary, source or f"來源{n}", names, topic)


def _edges(spark, *events):
    edges, clusters = graph.correlate(graph.extract_signals(spark.createDataFrame(events, EVENT)))
    return sorted((r["a"], r["b"], r["type"], round(r["weight"], 6)) for r in edges.collect()), sorted((r["n"], r["cluster"]) for r in clusters.collect())


def test_texts_of_one_case_from_two_sources_are_an_incident_but_no_cluster(spark):
    edges, clusters = _edges(spark, _event(1, "信義區毒品案 警方查獲安非他命"), _event(2, "北市信義分局緝毒 起獲海洛因", hours=4), _event(3, "國道一號追撞 釀三傷", category="交通"))
    assert [(a, b, t) for a, b, t, _ in edges] == [(1, 2, "same-incident")] and edges[0][3] < 1.5 and clusters == []


def test_general_words_procedure_and_countries_link_nothing(spark):
    assert _edges(spark, _event(1, "高雄假投資詐騙 老翁匯款百萬元", "高雄市", "反詐"), _event(2, "高雄假交友詐騙 女子匯款十萬元", "高雄市", "反詐", 1))[0] == []
    assert _edges(spark, _event(1, "柬埔寨詐騙園區人權團體籲救援受困者", "全國", "反詐"), _event(2, "柬埔寨掃蕩詐騙驚見毒品窩多名嫌犯被捕", "全國", "反詐"))[0] == []
    assert _edges(spark, _event(1, "修車行老闆遭判刑並賠償", "高雄市", summary="法院審理詐欺與洗錢案件。"), _event(2, "前偵查隊長偷拍遭起訴", "高雄市", summary="檢方偵辦詐欺相關案件時發現違法行為。"))[0] == []


def test_one_source_is_a_topic_and_a_shared_name_links_regions(spark):
    edges, _ = _edges(spark, _event(1, "桃園查獲毒品 逮二嫌", "桃園市", source="中央社"), _event(2, "桃園毒品案 逮捕二名嫌犯", "桃園市", hours=1, source="中央社"))
    assert edges == [(1, 2, "same-topic", 0.3)]
    edges, clusters = _edges(spark, _event(1, "鳳山分局破詐騙水房", "高雄市"), _event(2, "鳳山分局協助查緝車手", "臺南市", hours=24), _event(3, "無關", None, names=["鳳山分局", " "], topic=" 水房案 "))
    assert [(a, b, t) for a, b, t, _ in edges] == [(1, 2, "same-entity"), (1, 3, "same-entity"), (2, 3, "same-entity")] and clusters == [(1, 1), (2, 1), (3, 1)]


def test_signal_rows_of_missing_fields(spark):
    got = graph.extract_signals(spark.createDataFrame([(1, None, None, None, None, None, None, None, None)], EVENT)).first()
    assert (got["region"], got["category"], got["scope"], got["ts"], got["keywords"], got["entities"], got["grams"], got["topic"], got["source_name"]) == ("全國", "", "domestic", None, [], [], [], "", "")
    assert graph.extract_signals(spark.createDataFrame([], EVENT)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_one_scan_gives_what_each_pattern_alone_gives(spark, seed):
    r = random.Random(seed)
    scanner = signals.Scanner([*(p for p, _ in V.LEXICON), *V.ENTITY_PATTERNS])
    bits = [*scanner.every, "規模", "震度", "在", "中", "信義", "臺北", "x", " ", "五", "毒", "地", "分"]
    texts = [("".join(r.choice(bits) for _ in range(r.randint(0, 9))),) for _ in range(400)]
    df = spark.createDataFrame(texts, "t string").withColumn("h", scanner.hits(F.col("t")))
    tags, names = signals.text_signals(F.col("t"), F.col("h"), scanner)
    apart = df.select(tags.alias("a"), rules.tag_lexicon(F.col("t")).alias("b"), names.alias("c"), rules.extract_entities(F.col("t")).alias("d")).collect()
    assert sum(len(x["a"]) + len(x["c"]) for x in apart) > 300
    for x in apart:
        assert x["a"] == x["b"] and x["c"] == x["d"]


def test_words_of_patterns():
    assert signals.anchors("a|bc") == ["a", "bc"] and signals.anchors("(?i)the|and") is None and signals.anchors("[0-9]{3}") is None
    assert signals.anchors("規模.{0,3}地震|震度") == ["規模", "震度"] and signals.anchors("[一-鿿]{2,3}(?:路|街)") == ["路", "街"] and signals.anchors("x?yz+") == ["y"]


def _random_signals(r, n):
    pick = lambda kinds, most: [f"{r.choice(kinds)}{r.randrange(6)}" for _ in range(r.randint(0, most))]
    return [
        (i, r.choice(["A", "全國", "全國", ""]), r.choice(["c", "d", ""]), r.choice(["s", "t"]), r.choice([None, *(DAY + timedelta(hours=6 * r.randrange(30)) for _ in range(5))]), pick("k", 3), pick("e", 1), pick("abc", 22), "")
        for i in range(n)
    ]


SIGNAL = "n long, region string, category string, source_name string, ts timestamp, keywords array<string>, entities array<string>, grams array<string>, topic string"


def test_incidents_and_topics_equal_all_pairs_tried(spark):
    rows = _random_signals(random.Random(5), 260)
    at = lambda t: (t - datetime(1970, 1, 1)).total_seconds() if t else 0.0
    incident, topic = set(), set()
    for x in rows:
        for y in rows:
            if x[0] >= y[0] or x[1] != y[1]:
                continue
            k, e, g = (len(set(x[c]) & set(y[c])) for c in (5, 6, 7))
            dt, vague = abs(at(x[4]) - at(y[4])), x[1] in V.VAGUE_REGIONS
            least = min(len(set(x[7])), len(set(y[7])))
            strong = e >= 1 or (g >= 8 and g >= 0.6 * least)
            if x[3] != y[3] and k and dt <= 3 * 86400 and (strong if vague else e + g >= 1):
                incident.add((x[0], y[0], round(1 + 0.1 * min(k + e + g, 5), 6)))
            if x[3] == y[3] and k and dt <= 2 * 86400 and not vague and x[2] and x[2] == y[2]:
                topic.add((x[0], y[0]))
    df = spark.createDataFrame(rows, SIGNAL)
    got = [(r["a"], r["b"], round(r["weight"], 6)) for r in graph.same_incident(df).collect()]
    assert len(got) == len(set(got)) and set(got) == incident and len({p for p in got if rows[p[0]][1] in V.VAGUE_REGIONS}) > 20
    got = [(r["a"], r["b"]) for r in graph.same_topic(df).collect()]
    assert len(got) == len(set(got)) and set(got) == topic


def test_a_gram_of_half_of_a_vague_region_makes_no_candidates(spark):
    def candidates(n):
        grams = lambda i: [f"own{i}-{j}" for j in range(9)] + (["common"] if i % 2 else [])
        pairs = lambda i: [f"pair{i // 2}-{j}" for j in range(9)]  # noqa: E731  a title that two events share
        rows = [(i, "全國", "c", f"s{i}", DAY, ["k"], [], grams(i) if i % 10 else pairs(i // 10), "") for i in range(n)]
        df = spark.createDataFrame(rows, SIGNAL)
        return graph.incident_candidates(df).count(), graph.same_incident(df).count()

    few, many = candidates(200), candidates(800)
    assert few == (10, 10) and many == (40, 40)


def test_stars_of_many_points_of_one_region(spark):
    g = np.random.default_rng(1)
    places = [(float(a), float(b)) for a, b in zip(np.round(g.uniform(20, 60, 50_000), 2), np.round(g.uniform(100, 160, 50_000), 2), strict=True)]
    rows = [("r", i, *p) for i, p in enumerate(places)] + [("r", 50_000, None, 1.0), ("r", 50_001, 99.0, 1.0), (None, 50_002, 10.0, 179.99), (None, 50_003, 10.0, -179.99)]
    got = graph.geo_star_clusters(spark.createDataFrame(rows, "region string, n long, lat double, lng double"), "region").collect()
    # The plain loop, with points tried by latitude only.
    points = sorted(set(places))
    lat = np.radians([p[0] for p in points])
    lng = np.radians([p[1] for p in points])
    star, seeds = np.full(len(points), -1), 0
    for i in range(len(points)):
        if star[i] < 0:
            h = np.sin((lat - lat[i]) / 2) ** 2 + np.cos(lat) * np.cos(lat[i]) * np.sin((lng - lng[i]) / 2) ** 2
            star[(star < 0) & (2 * 6371.0088 * np.arcsin(np.sqrt(h)) <= 15)] = seeds
            seeds += 1
    want = dict(zip(points, star.tolist(), strict=True))
    assert {r["n"]: r["geo"] for r in got if r["region"] == "r"} == {i: want[p] for i, p in enumerate(places)}
    assert sorted((r["n"], r["geo"], r["size"]) for r in got if r["region"] is None) == [(50_002, 0, 2), (50_003, 0, 2)]


def test_a_component_beyond_the_bound_is_refused(spark):
    rows = [("r", i, 10 + i / 1000, 20.0) for i in range(30)]
    with pytest.raises(ValueError, match="30 distinct places"):
        graph.geo_star_clusters(spark.createDataFrame(rows, "region string, n long, lat double, lng double"), "region", most=29)


def test_ranks_of_a_large_group_nulls_and_an_empty_table(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(50)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {x["i"]: (x["rank"], x["n"]) for x in ranking.ranked(df, ["g"], [F.desc_nulls_last("v"), F.asc("i")], count="n").collect()}
    want = {}
    for g in ("a", "b", None):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
        want |= {x[2]: (k, len(own)) for k, x in enumerate(own, 1)}
    assert got == want
    assert ranking.ranked(df.limit(0), ["g"], [F.asc("v")]).count() == 0
    assert sorted(x["rank"] for x in ranking.ranked(df, [], [F.asc("i")]).collect()) == list(range(1, 3001))
