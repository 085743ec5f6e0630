"""WARC Merkle fixity audit.

Records are hashed, and hashes are hashed upward over ordered ranges of 16
keys each until every archive file has a root. A key is a record's place in the
order of its replica; a file is a range of keys. Where keys are sparse, a range
holds few records and the descent saves little. Two replicas are compared from
the roots down: only children of mismatching nodes are joined at each level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconframe.operators.state import materialize

#: Levels above the records. A node has 16 children, so an archive file holds 16 ** LEVELS record keys.
LEVELS = 3


def warc_record(uri: Column, body: Column) -> Column:
    """The bytes of a WARC/1.1 resource record, its id drawn from its content."""
    data = F.coalesce(body.cast("binary"), F.lit("").cast("binary"))
    digest = F.sha2(data, 256)
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:"), digest, F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nWARC-Block-Digest: sha256:"), digest, F.lit("\r\nContent-Length: "), F.length(data).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), data, F.lit("\r\n\r\n").cast("binary"))


def merkle_tree(records: DataFrame, key: str, payload: str) -> DataFrame:
    """(level, node, digest): level 0 has one node for each key, level LEVELS one root for each archive file.

    A null key takes no part; rows that repeat a key are hashed together, in
    the order of their hashes; a null payload differs from an empty one; other
    columns are ignored; an empty table gives an empty tree.
    """
    leaf = records.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("node"), F.coalesce(F.sha2(F.col(payload).cast("binary"), 256), F.lit("null")).alias("h"))
    # Repeats are counted before they are joined, so many copies of one record are one entry.
    leaf = leaf.groupBy("node", "h").agg(F.count("*").alias("n")).groupBy("node").agg(F.array_sort(F.collect_list(F.concat_ws("*", "h", "n"))).alias("c"))
    level = leaf.select(F.lit(0).alias("level"), "node", F.sha2(F.concat_ws(",", "c"), 256).alias("digest"))
    tree = level
    for i in range(1, LEVELS + 1):
        parts = level.select(F.shiftright("node", 4).alias("up"), F.struct("node", "digest").alias("x"))
        level = parts.groupBy("up").agg(F.array_sort(F.collect_list("x")).alias("c")).select(F.lit(i).alias("level"), F.col("up").alias("node"), F.sha2(F.concat_ws(",", F.transform("c", lambda x: F.concat_ws(":", x["node"], x["digest"]))), 256).alias("digest"))
        tree = tree.union(level)
    return tree


def fixity_audit(left: DataFrame, right: DataFrame, key: str, payload: str) -> DataFrame:
    """(record, file, status) of each record that is not the same in both replicas: changed, missing (in right) or added.

    Null keys take no part; rows that repeat a key are one record; a null
    payload differs from an empty one; other columns are ignored, whatever
    their names; two empty tables give an empty result.
    """
    a, b = materialize(merkle_tree(left, key, payload), "tree"), materialize(merkle_tree(right, key, payload), "tree")
    suspects = None
    for level in range(LEVELS, -1, -1):
        x, y = (t.where(F.col("level") == level).select("node", F.col("digest").alias(n)) for t, n in ((a, "x"), (b, "y")))
        if suspects is not None:
            up = suspects.select(F.col("node").alias("up"))
            x, y = (t.withColumn("up", F.shiftright("node", 4)).join(up, "up", "left_semi").drop("up") for t in (x, y))
        suspects = materialize(x.join(y, "node", "full").where(~F.col("x").eqNullSafe(F.col("y"))), f"level{level}")
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "added").otherwise("changed")
    return suspects.select(F.col("node").alias("record"), F.shiftright("node", 4 * LEVELS).alias("file"), status.alias("status"))
