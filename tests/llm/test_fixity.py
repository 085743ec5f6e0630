"""The fixity audit on odd rows: large and null keys, null payloads, repeated rows, clashing columns, empty replicas."""

from beaconframe.llm.fixity import fixity_audit

SCHEMA = "k long, p string, node int, level int, digest string, up int, x int"


def _audit(spark, left, right):
    frame = lambda rows: spark.createDataFrame([(k, p, 0, 0, "", 0, 0) for k, p in rows], SCHEMA)
    return sorted((r["record"], r["file"], r["status"]) for r in fixity_audit(frame(left), frame(right), "k", "p").collect())


def test_large_null_and_repeated_rows(spark):
    big = (1 << 62) + 4095
    left = [(big, "a"), (1, None), (2, ""), (3, "c"), (3, "c"), (None, "n"), (-1, "m"), (5, "y" * 1_000_000)]
    assert _audit(spark, left, left[::-1]) == []
    right = [(big, "b"), (1, ""), (2, ""), (3, "c"), (None, "other"), (-1, "m"), (5, "y" * 1_000_000)]
    assert _audit(spark, left, right) == [(1, 0, "changed"), (3, 0, "changed"), (big, big // 4096, "changed")]


def test_empty_replicas(spark):
    assert _audit(spark, [], []) == []
    assert _audit(spark, [(7, "a")], []) == [(7, 0, "missing")] and _audit(spark, [], [(7, "a")]) == [(7, 0, "added")]
