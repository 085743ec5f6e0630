"""Connected components of an edge table, by alternating star contractions.

A large-star step hooks each node's larger neighbours to the smallest
neighbour, a small-star step does the same for the smaller ones. The smallest
neighbour is an aggregate with partial results, joined back to the edges, so a
hub's edges are never one task's group: AQE splits them in the join. The edge
list never grows and the number of rounds is logarithmic in the longest path.
Rounds are cut by tables in the shared folder, so a lost executor costs one
round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconframe.operators.state import Scratch, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Edges are (u, v) with u > v; the result has the same form."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    near = both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("u", "m"))
    if large:
        moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, table: Scratch | None = None) -> DataFrame:
    """(node, component) for every node that has an edge to another node.

    `component` is the smallest node reachable. Self loops, repeated edges,
    either direction and rows with a null end are accepted; nulls and loops
    add nothing. An empty edge table gives an empty result, which is written to
    the shared folder, or among the tables of the job `table` if that is given.
    """
    now = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
        .where(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("u") != F.col("v")))
        .select("u", "v")
        .distinct()
    )
    with Scratch(edges.sparkSession) as own:
        now = own(now, "edges")
        for _ in range(max_rounds):
            # A forest of stars is a fixed point: no node has two smaller neighbours or is both a child and a centre.
            ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
            if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty():
                break
            before, now = now, own(_star(_star(now, True), False), "edges")
            own.drop(before)
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        return (table or materialize)(
            now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components"
        )
