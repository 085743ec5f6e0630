"""Queries that once gave less than their whole job, against their SQL on tables where that shows."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture
def crowd(tmp_path):
    """120 events of three users, two of whom have more than 40 events; one of these shares a region with the third."""
    con = duckdb.connect()
    con.execute("CREATE TABLE nation AS SELECT range::INTEGER AS n_nationkey, 'n' || range AS n_name FROM range(25)")
    con.execute("""CREATE TABLE events AS SELECT range AS event_id, TIMESTAMP '2024-01-01' + to_hours(CAST(range AS INTEGER)) AS ts, CASE WHEN range % 12 = 5 THEN 55 WHEN range % 2 = 0 THEN 10 ELSE 30 END::BIGINT AS user_id, 'view' AS event_type, (range % 90)::DOUBLE AS value, '{"k": 1}' AS props FROM range(120)""")
    for table in ("nation", "events"):
        con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    return con, str(tmp_path)


def _both(spark, crowd, name):
    con, folder = crowd
    told = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in told.description]
    got = entry.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    return Counter(map(tuple, got.select(names).collect())), Counter(told.fetchall()), names


def test_entities_of_many_events_have_strongest_neighbours(spark, crowd):
    got, want, names = _both(spark, crowd, "j13_strongest")
    assert got == want
    entity = [dict(zip(names, row, strict=True)) for row in got]
    # Both large groups are beyond the 40 events that an entity might have before; the third one has incidents enough.
    assert len({e["node"] for e in entity if e["type"] == "entity"}) == 110


def test_each_official_item_is_an_event_of_its_own(spark, crowd):
    con, folder = crowd
    con.execute("UPDATE events SET event_id = event_id * 3 + 1001 WHERE user_id = 30")
    con.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    got, want, names = _both(spark, crowd, "n37_official")
    assert got == want and set(got.values()) == {1}
    rows = [dict(zip(names, row, strict=True)) for row in got]
    assert {r["n"] for r in rows} == {n for (n,) in con.execute("SELECT event_id FROM events WHERE user_id % 5 = 0").fetchall()}
    kinds = {f: [r for r in rows if r["fallback"] is f] for f in (False, True)}
    assert {r["region"] for r in kinds[True]} == {"國際"} and {r["region"] for r in kinds[False]} == {"n10"}
    assert {"critical", "low"} <= {r["risk"] for r in kinds[True]} and {r["category"] for r in rows} == {"治安", "反詐", "協尋"}


def test_incidents_and_topics_are_pairs(spark, crowd):
    con, _ = crowd
    for name, columns in (("j01_scored_incidents", {"a", "b", "weight"}), ("j02_same_topic", {"a", "b"})):
        got, want, names = _both(spark, crowd, name)
        assert set(names) == columns and got == want and set(got.values()) == {1}
        assert all(row[names.index("a")] < row[names.index("b")] for row in got)
