"""Nested reports and records of unlike form: what they hold, as rows of (path, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconframe.operators.state import Scratch, materialize

_NODE = "key string, path string, kind string, value string"


def flatten(df: DataFrame, key: str, value: str, root: str = "report", most: int = 64, table: Scratch | None = None) -> DataFrame:
    """(key, path, kind, value) of each node of the JSON text `value` of each row.

    Objects and arrays have their sorted keys and their length as value, leaves
    their JSON text; kind is object, array or leaf. One level at a time is taken
    apart as VARIANT, so it takes as many passes as the deepest text has levels;
    more than `most` are an error. Null texts and such as are no JSON give no
    node. The result is written, among the tables of the job `table` if that is given.
    """
    spark = df.sparkSession
    with Scratch(spark) as own:
        level = df.select(F.col(key).cast("string").alias("key"), F.lit(root).alias("path"), F.try_parse_json(F.col(value)).alias("v")).where("v is not null")
        kind = F.schema_of_variant("v")
        kind = F.when(kind.startswith("OBJECT<"), "object").when(kind.startswith("ARRAY<"), "array").otherwise("leaf")
        found, depth = [], 0
        while True:
            level = own(level.withColumn("kind", kind), f"level{depth}")
            inner = level.where("kind <> 'leaf'")
            leaves = level.where("kind = 'leaf'").select("key", "path", "kind", F.coalesce(F.to_json("v"), F.lit("null")).alias("value"))
            if inner.isEmpty():
                found.append(leaves)
                break
            depth += 1
            if depth > most:
                raise ValueError(f"a text has more than {most} levels")
            # Each node and, where it has any, its members; an empty object or array has one row without a member.
            below = own(spark.sql("SELECT l.key, l.path, l.kind, e.pos, e.key AS name, e.value AS v FROM {inner} l, LATERAL variant_explode_outer(l.v) e", inner=inner), f"below{depth}")
            names = F.to_json(F.array_sort(F.collect_list("name")))
            nodes = below.groupBy("key", "path", "kind").agg(names.alias("names"), F.count("v").alias("n"))
            found += [leaves, nodes.select("key", "path", "kind", F.when(F.col("kind") == "object", F.col("names")).otherwise(F.col("n").cast("string")).alias("value"))]
            step = F.when(F.col("kind") == "object", F.concat(F.lit("."), "name")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
            level = below.where("v is not null").select("key", F.concat("path", step).alias("path"), "v")
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return (table or materialize)(out, "nodes")


def report_differences(actual: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """Q03: (key, path, difference, expected, actual): where JSON reports of equal keys differ.

    difference is missing or unexpected (reports that only one side has), or the
    first that applies to a path: type, keys, length, value. Below a place whose
    type, keys or length differ nothing more is told. Equal reports give no row;
    of several differences of one report the reference's own check stops at the
    first, here all are given.
    """
    with Scratch(expected.sparkSession) as table:
        a, e = flatten(actual, key, value, table=table), flatten(expected, key, value, table=table)
        side = lambda df, s: df.select("key", "path", F.col("kind").alias(f"{s}_kind"), F.col("value").alias(s))
        both = table(side(a, "actual").join(side(e, "expected"), ["key", "path"], "full"), "both")
        one = both.where("path = 'report' and (actual_kind is null or expected_kind is null)").select("key", "path", F.when(F.col("actual_kind").isNull(), "missing").otherwise("unexpected").alias("difference"), "expected", "actual")
        here = both.where("actual_kind is not null and expected_kind is not null and (actual_kind <> expected_kind or actual <> expected)")
        what = F.when(F.col("actual_kind") != F.col("expected_kind"), "type").when(F.col("expected_kind") == "object", "keys").when(F.col("expected_kind") == "array", "length").otherwise("value")
        told = table(here.select("key", "path", what.alias("difference"), "expected", "actual"), "told")
        # What lies below a differing object or array differs only because of it.
        above = told.where("difference <> 'value'").select("key", F.col("path").alias("top"))
        below = told.select("key", "path", F.explode(F.expr("filter(transform(sequence(1, length(path)), i -> if(substring(path, i, 1) in ('.', '['), substring(path, 1, i - 1), null)), x -> x is not null)")).alias("top")).join(above, ["key", "top"]).select("key", "path").distinct()
        return materialize(one.unionByName(told.join(below, ["key", "path"], "left_anti")), "differences")


def preview_records(df: DataFrame, value: str, order: str, n: int = 50, columns: int = 40, most: int = 1000) -> tuple[DataFrame, list[str], int]:
    """(order, cells map) of the first `n` records, the `columns` first keys of all records, and the number of records.

    Records are JSON objects of any form. Keys come by the first record that has
    them and their place in it; a record has no cell for a key that it lacks.
    Cells are texts cut to `most` letters, nested values as JSON. Texts that are
    no object count as records without keys.
    """
    text = F.col(value).cast("string")
    keyed = df.select(F.col(order).alias("_o"), F.posexplode(F.json_object_keys(text)).alias("_p", "key"))
    keys = [r["key"] for r in keyed.groupBy("key").agg(F.min(F.struct("_o", "_p")).alias("at")).orderBy("at").limit(columns).collect()]
    every = F.coalesce(F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))
    some = F.map_filter(every, lambda k, v: k.isin(*keys) & v.isNotNull()) if keys else F.create_map().cast("map<string,string>")
    return df.orderBy(order).limit(n).select(order, F.transform_values(some, lambda k, v: F.substring(v, 1, most)).alias("cells")), keys, df.count()
