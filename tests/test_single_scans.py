"""Long texts and blocks are made and cut out once for all that looks into them, with the results of the plain rules."""

import random
import re

from pyspark.sql import functions as F

from beaconframe.functions import rules as R
from beaconframe.functions import vocabulary as V
from beaconframe.plans.rules import c04_official_risks
from beaconframe.sources import feeds


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _risk(title, hint, description):
    both = f"{title} {description or ''}"
    has = lambda p: re.search(p, both) is not None
    routine = re.search(V.ROUTINE, title) is not None
    cyber = routine or re.search(V.CYBER_ROUTINE, title) is not None
    high, medium = has(V.HIGH) or has(V.HIGH_EN), has(V.MEDIUM) or has(V.MEDIUM_EN)
    general = "high" if high else "low" if routine else "medium" if medium else "low"
    if has(V.CRITICAL) and not has(V.NO_CASUALTY):
        return "critical"
    if has(V.HIGH_FLOOR) or not cyber and has(V.CYBER_HIGH):
        return "high"
    if not cyber and has(V.DATA_BREACH):
        return "high" if has(V.BREACH_SCALE) else "medium"
    if hint not in V.TOPIC_RISKS:
        return general
    if hint == V.CYBER and cyber:
        return "low"
    own_high, own_medium = V.TOPIC_RISKS[hint]
    return "high" if has(own_high) or high else "low" if routine else "medium" if has(own_medium) else general


def test_f28_risk_of_long_texts_by_the_plain_rules_with_the_texts_made_once(spark):
    r = random.Random(3)
    parts = ["氣爆", "死", "3", "12 ", "無人傷亡", "宣導", "講座", "勒索", "個資外洩", "百萬", "持刀", "致死", "詐騙", "中毒", "下架", "傷", "死角", "murder", "fire", "x.", "\n", " ", "上市", "é", "，000"]
    text = lambda n: "".join(r.choice(parts) for _ in range(r.randint(0, n)))
    plain = lambda n: " ".join(r.choice(["murder", "fire", "3", "12", "é", "x", "\n"]) for _ in range(r.randint(0, n)))
    rows = [(i, text(3), r.choice(["", "治安", *V.TOPIC_RISKS]), r.choice([None, text(4), plain(4), plain(4)])) for i in range(1500)]
    df = spark.createDataFrame(rows, "n int, t string, h string, d string").repartition(2)
    told = df.select("n", R.rate_risk(F.col("t"), F.col("h"), F.col("d")).alias("risk"))
    assert {x["n"]: x["risk"] for x in told.collect()} == {n: _risk(t, h, d) for n, t, h, d in rows}
    assert _plan(told).count("concat(") <= 2


def test_f29_an_alert_s_blocks_are_cut_out_once(spark):
    rows = [(1, "<alert><identifier> a &amp;amp; b　c </identifier><info><severity>Minor</severity><area><areaDesc><![CDATA[x]]> y</areaDesc></area></info></alert>"), (2, "<cap:identifier>z</cap:identifier>"), (3, None), (4, "<alert><identifier> </identifier></alert>")]
    found = feeds.parse_cap(spark.createDataFrame(rows, "n int, x string").repartition(2), "x", ["n"])
    assert sorted(tuple(x) for x in found.select("n", "identifier", "severity", "areaDesc").collect()) == [(1, "a &amp; b c", "Minor", "x y"), (2, "z", None, None)]
    assert _plan(found).count("?info(?:") <= 1


def test_f30_many_risks_of_a_row_are_not_one_method_that_is_too_large_to_be_compiled(spark):
    texts = [(1, "A2", "死亡 1 受傷 0"), (2, "A1", "死亡 0 受傷 9"), (3, "A2", "死亡 0 受傷 3"), (4, "A2", "受傷 1"), (5, None, None), (6, "A1", None)]
    found = spark.createDataFrame(texts, "n int, k string, t string").repartition(2).select("n", R.risk_by_casualties(F.col("k"), F.col("t")).alias("risk"))
    assert {x["n"]: x["risk"] for x in found.collect()} == {1: "critical", 2: "high", 3: "high", 4: "medium", 5: "low", 6: "high"}
    plan = c04_official_risks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    (step,) = [line for line in plan.splitlines() if "Project" in line]
    assert not re.search(r"\*\(\d+\) Project", step)
