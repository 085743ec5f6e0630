"""Small cases of the event operators, and every query with SQL against that SQL on the smallest tables."""

import os
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import duckdb
import pytest

from beaconframe.operators import components, evidence, rollups, selection
from beaconframe.plans import queries

SF = "/root/testdata/sf0.001"


def test_first_wins_drops_empty_keys_and_keeps_the_first(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("", 0), (None, 0), ("b", 5)], "k string, o int")
    assert sorted(map(tuple, selection.first_wins(df, "k", "o").collect())) == [("a", 1), ("b", 5)]


def test_prefer_union_takes_fresh_rows_and_each_key_once(spark):
    fresh = spark.createDataFrame([(1, "f"), (1, "g"), (None, "x")], "k int, v string")
    old = spark.createDataFrame([(1, "o"), (2, "o"), (2, "p")], "k int, v string")
    assert sorted(map(tuple, selection.prefer_union(fresh, old, "k").collect())) == [(1, "f"), (2, "o")]


def test_first_wins_keeps_empty_keys_on_request_and_settles_ties(spark):
    df = spark.createDataFrame([("a", 1, "z"), ("a", 1, "y"), ("", 0, "x"), (None, 0, "w")], "k string, o int, v string")
    assert sorted(r["v"] for r in selection.first_wins(df, "k", "o", keep_empty=True).collect()) == ["w", "x", "y"]


def test_daily_cells_count_unknown_scope_and_risk_in_total_only(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, "domestic", "low", "a"), (t, None, "odd", " "), (t, "lunar", None, None)], "ts timestamp, scope string, risk string, category string")
    got = {(r["dim"], r["value"]): r["n"] for r in rollups.daily_cells(df).collect()}
    assert got == {("total", "all"): 3, ("scope", "domestic"): 1, ("risk", "low"): 1, ("category", "a"): 1, ("category", "uncategorised"): 2}


def test_components_of_a_path_a_loop_and_nulls(spark):
    df = spark.createDataFrame([(5, 4), (4, 3), (3, 3), (9, 8), (7, None)], "a long, b long")
    assert sorted(map(tuple, components.connected_components(df).collect())) == [(3, 3), (4, 3), (5, 3), (8, 8), (9, 8)]


def test_same_incident_needs_two_sources_and_three_days(spark):
    t = [datetime(2024, 1, d) for d in (1, 4, 8)]
    df = spark.createDataFrame([("r", "k", 1, t[0], "x"), ("r", "k", 2, t[1], "y"), ("r", "k", 3, t[2], "x"), ("r", "k", 4, t[0], "x")], "region string, tag string, n long, ts timestamp, source_name string")
    assert sorted(map(tuple, evidence.same_incident_pairs(df).collect())) == [(1, 2), (2, 4)]


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def _outcome(spark, name):
    """(Spark's names and rows, the SQL's names and rows), or the exception."""
    try:
        con = duckdb.connect()
        for table in os.listdir(SF):
            con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{table}'")
        found = queries.queries()[name](spark, SF)
        got = sorted(found.columns), _rows(found.columns, found.collect())
        if name not in queries.oracle_sql():
            return got, None
        told = con.execute(queries.oracle_sql()[name])
        names = [c[0] for c in told.description]
        return got, (sorted(names), _rows(names, told.fetchall()))
    except Exception as e:  # noqa: BLE001  told by the test of that query
        return e, None


@pytest.fixture(scope="module")
def outcomes(spark):
    """All queries, several at a time: at this size they wait for Spark's scheduling more than they compute."""
    with ThreadPoolExecutor(6) as pool:
        return dict(zip(queries.queries(), pool.map(lambda name: _outcome(spark, name), queries.queries()), strict=True))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_against_sql(outcomes, name):
    got, want = outcomes[name]
    if isinstance(got, Exception):
        raise got
    assert want is None or got == want


def test_the_sql_of_official_items_orders_titles_whole():
    """A title that begins another is the smaller one, whatever follows it."""
    con = duckdb.connect()
    con.execute("CREATE TABLE nation AS SELECT range AS n_nationkey, 'n' || range AS n_name FROM range(25)")
    con.execute("""CREATE TABLE events AS SELECT * FROM (VALUES (0, 5, 12.0), (3, 5, 62.0)) t(event_id, user_id, value), (VALUES (TIMESTAMP '2024-01-01', 'view', '{"k": 1}')) u(ts, event_type, props)""")
    assert {r[1] for r in con.execute(queries.oracle_sql()["n37_official"]).fetchall()} == {"k1 view v12"}
    con.execute("UPDATE events SET value = 5.0 WHERE event_id = 0")
    assert {r[1] for r in con.execute(queries.oracle_sql()["n37_official"]).fetchall()} == {"k1 view v1"}
