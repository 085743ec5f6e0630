"""Column functions and rules on inline rows: nulls, odd texts, the default word lists."""

from datetime import datetime

from pyspark.sql import functions as F

from beaconframe.functions import dates as D
from beaconframe.functions import places as P
from beaconframe.functions import rules as R
from beaconframe.functions import text as T
from beaconframe.operators import filters

NOW = datetime(2024, 1, 1)
lit = F.lit


def _cases():
    null = lit(None).cast("string")
    return {
        "clean title": (T.clean_title(lit("某某新聞 - 中央社")), "某某新聞"),
        "clean title of a suffix alone": (T.clean_title(lit(" - 中央社")), "- 中央社"),
        "clean title of null": (T.clean_title(null), ""),
        "title key": (T.title_key(lit("A 某-b ｜ X媒")), "a某b"),
        "hash of an astral letter": (T.djb2_36(lit("a\U0001f600")), "38bdk3"),
        "no link, no id": (T.event_id(lit("domestic"), null), None),
        "fingerprint": (T.fingerprint(lit("d"), lit(" "), null, lit("t")), "d:t"),
        "markup": (T.strip_markup(lit("<![CDATA[<b>a</b>]]> &lt;p style=x&gt; c&nbsp;d &amp;amp;")), "a c d &amp;"),
        "page": (T.strip_page(lit("<SCRIPT>x</script>a&NBSP;b")), "a b"),
        "compact": (T.compact(lit("abc  def"), 5), "abc …"),
        "match form": (T.normalize_for_match(lit("Ａb-1 。")), "ab1"),
        "no array": (T.clean_array(lit(None).cast("array<string>")), None),
        "output without JSON": (T.extract_json(lit("none"), "array<struct<a:int>>"), None),
        "roc date": (D.roc_date(lit("113/05/01")), "2024-05-01T12:00:00+08:00"),
        "short roc date": (D.roc_date(lit("1135")), None),
        "afternoon": (D.local_datetime(lit("2024/5/1 下午 12:04")), "2024-05-01T12:04:00+08:00"),
        "after midnight": (D.local_datetime(lit("2024/5/1 上午 12:04")), "2024-05-01T00:04:00+08:00"),
        "third ten days of February": (D.ten_day_date(lit("2023"), lit("2"), lit("下旬")), "2023-02-28"),
        "cumulative label": (D.roc_period(lit("115年 (1~4月)")), None),
        "verdict": (D.temporal_state(lit("x"), lit("判決"), lit(None).cast("timestamp"), NOW), "judicial"),
        "no time": (D.temporal_state(lit("x"), lit("y"), lit(None).cast("timestamp"), NOW), None),
        "revised number": (P.clean_number(lit("1,234.5r")), 1234.5),
        "placeholder": (P.clean_number(lit("…")), None),
        "county of an address": (P.county_of_address(lit("270宜蘭縣蘇澳"))["region"], "宜蘭縣"),
        "old spelling": (P.county_of_address(lit("台北市"))["region"], "臺北市"),
        "no county": (P.detect_county(lit("火星"))["region"], "全國"),
        "zero coordinates": (P.valid_coord(lit(0.0), lit(0.0)), False),
        "null coordinates": (P.in_bbox(lit(None).cast("double"), lit(1.0), 0, 0, 2, 2), False),
        "migrant is no search": (R.categorize(lit("失聯移工協尋"), lit(""))["category"], "治安"),
        "search": (R.categorize(lit("老翁走失"), lit(""))["category"], "協尋"),
        "explosion with dead": (R.rate_risk(lit("氣爆 3死"), lit(""), null), "critical"),
        "no casualties": (R.rate_risk(lit("大規模爆炸 無人傷亡"), lit(""), null), "high"),
        "cyber lecture": (R.rate_risk(lit("資安講座 勒索"), lit("資安"), null), "low"),
        "large breach": (R.rate_risk(lit("個資外洩 百萬筆"), lit("資安"), null), "high"),
        "breach": (R.rate_risk(lit("個資外洩"), lit("資安"), null), "medium"),
        "never up": (R.calibrate_risk(lit("low"), lit("金融"), lit("x"), lit(None).cast("int")), "low"),
        "one down": (R.calibrate_risk(lit("critical"), lit("金融"), lit("x"), lit(None).cast("int")), "high"),
        "crisis stays": (R.calibrate_risk(lit("critical"), lit("金融"), lit("地震"), lit(0)), "critical"),
        "no price": (R.risk_by_price(null), "low"),
        "price": (R.risk_by_price(lit("100000000")), "high"),
        "no blocked amount": (R.risk_by_blocked(null), "medium"),
        "one robbery": (R.risk_by_weekly(lit("強盜"), lit(1)), "medium"),
        "blank alert level": (R.risk_by_river(lit(5.0), lit(" "), lit("9"), lit("9")), "low"),
        "tags": (R.tag_lexicon(lit("詐騙毒品")), ["詐欺", "毒品"]),
        "entities": (R.extract_entities(lit("在中山路 信義分局"), F.array(lit("警方"), lit("ABC"))), ["信義分局", "中山路", "ABC"]),
        "bigrams without the region": (R.shingle(lit("臺北市失火了"), lit("臺北市")), ["失火", "火了"]),
        "enforcement is no outreach": (filters.is_outreach_noise(lit("反詐宣導 查獲車手"), null, null), False),
        "outreach": (filters.is_outreach_noise(lit("反詐宣導"), null, null), True),
        "foreign war": (filters.is_foreign_only(lit("烏克蘭 空襲"), null), True),
        "home is told of": (filters.is_foreign_only(lit("烏克蘭 空襲"), lit("台灣捐款")), False),
        "home is denied": (filters.is_foreign_only(lit("烏克蘭 空襲"), lit("與台灣無關聯")), True),
        "null title": (filters.is_relevant(null, null, null, null), False),
    }


def test_values_of_inline_rows(spark):
    cases = _cases()
    got = spark.range(1).select(*(c.alias(name) for name, (c, _) in cases.items())).first().asDict()
    assert {n: v for n, v in got.items() if v != cases[n][1]} == {}


def test_settled_letters_are_those_that_nfkc_leaves():
    import re
    import unicodedata

    from beaconframe.functions.text import SETTLED

    some = "".join(c for c in map(chr, range(0x20, 0xFFFF)) if re.match(f"[{SETTLED}]", c))
    assert len(some) > 20_000 and unicodedata.normalize("NFKC", some) == some and not any(map(unicodedata.combining, some))


def test_sizes_of_the_files_that_a_table_reads(spark, tmp_path):
    import os

    from beaconframe.operators.aggregates import size_audit

    path = str(tmp_path / "t")
    spark.range(10_000).repartition(3).write.parquet(path)
    spark.range(1).coalesce(1).write.mode("append").parquet(path)
    got = {r["file"].rsplit("/", 1)[-1]: (r["size"], r["over"]) for r in size_audit(spark.read.parquet(path), 2000).collect()}
    want = {f: os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet")}
    assert got == {f: (n, n > 2000) for f, n in want.items()} and {over for _, over in got.values()} == {True, False}


def test_numbers_are_cleaned_without_patterns(spark):
    c = F.col("s")
    df = spark.createDataFrame([(x,) for x in ("1,2r", "P3.50", "…", "1000.500", "100", "")], "s string").select(P.clean_number(c).alias("number"), P.cell_number(c).alias("cell"), P.format_ntd(c).alias("ntd"))
    assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in df.collect()] == [(12.0, 0.0, "NT$1,2r"), (3.5, 0.0, "NT$P3.50"), (None, 0.0, "NT$…"), (1000.5, 1000.5, "NT$1,000.5"), (100.0, 100.0, "NT$100"), (None, 0.0, "NT$")]
