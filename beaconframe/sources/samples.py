"""Review samples as lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a review sample; the last three are for its reader.
COLUMNS = ("id", "title", "summary", "category", "risk", "human_category", "human_risk", "notes")
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)


def write_samples(df: DataFrame, path: str) -> None:
    """One line for each row, with empty texts where a column is missing or null."""
    there = set(df.columns)
    df.select(F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in there else F.lit("").alias(c) for c in COLUMNS))).alias("value")).write.text(path)


def read_samples(spark: SparkSession, path: str, broken: str = "fail") -> DataFrame:
    """The samples of a file or folder; blank lines are skipped. A line that is no JSON object is an error, or with `broken` 'keep' a row of nulls with the line in `_broken`."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{SCHEMA}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    bad = F.coalesce(F.col("r._broken").isNotNull() | F.try_parse_json("value").isNull() | ~F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(True))
    if broken == "fail":
        return parsed.select(F.when(bad, F.raise_error(F.concat(F.lit("a line of the sample is no JSON object: "), F.substring("value", 1, 200))).cast("boolean")).otherwise(F.lit(True)).alias("_fine"), "r.*").where("_fine").select(*COLUMNS)
    return parsed.select(*(F.when(~bad, F.col(f"r.{c}")).alias(c) for c in COLUMNS), F.when(bad, F.col("value")).alias("_broken"))
