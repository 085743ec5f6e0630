"""Small cases of the rollup's retention, the calibration of the hourly minimum, and neighbours by weight and type."""

from datetime import datetime, timedelta

from beaconframe.operators import evidence, rollups


def test_neighbours_by_weight_and_type(spark):
    edges = spark.createDataFrame([(0, i, "entity", i) for i in range(1, 31)] + [(5, 0, "incident", 99)], "a long, b long, type string, weight long")
    top = lambda **x: [(r["other"], r["type"]) for r in evidence.strongest_neighbours(edges, **x).where("node = 0").orderBy("rank").collect()]
    assert top() == [(5, "incident"), *((i, "entity") for i in range(30, 11, -1))]
    assert top(k=2, types=["entity"]) == [(30, "entity"), (29, "entity")] and top(types=["incident"]) == [(5, "incident")]


def test_rollup_keeps_ninety_days_up_to_the_newest_current_day(spark):
    cells = lambda rows: spark.createDataFrame(rows, "day string, dim string, value string, n long")
    day = lambda i: (datetime(2024, 6, 30) - timedelta(days=i)).strftime("%Y-%m-%d")
    old = [(day(i), "total", "all", 5) for i in (-3, 0, 89, 90)]
    got = lambda new: sorted((r["day"], r["n"]) for r in rollups.merge_rollup(cells(old), cells(new)).collect())
    assert got([(day(0), "total", "all", 7), (day(1), "total", "all", 2)]) == [(day(89), 5), (day(1), 2), (day(0), 7), (day(-3), 5)]
    assert got([]) == [(day(0), 5), (day(-3), 5)]


def test_calibration_takes_the_order_statistic_or_the_fallback(spark):
    now = datetime(2024, 6, 30, 12)
    run = lambda hours, n, news=True, hour="x": (now - timedelta(hours=hours), hour, n, news)
    left_out = [run(-1, 1), run(169, 1), run(3, 0), run(4, 1, False), run(0, 1, True, "2024-06-30 20:00"), (None, "x", 1, True)]
    got = lambda rows: tuple(rollups.calibrate_minimum(spark.createDataFrame(rows, "generated_at timestamp, hour string, n long, has_news boolean"), now).first())
    assert got(left_out) == (200, 0) and got(left_out + [run(1, 9)]) == (9, 1)
    for size in (4, 5, 8, 9):
        assert got(left_out + [run(i + 1, 10 * i + 10) for i in range(size)]) == (10 * ((size - 1) // 4) + 10, size)
    assert got([run(168, 7), run(1, 7), run(2, 7), run(3, 8)]) == (7, 4)
