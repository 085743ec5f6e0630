"""Look-ups: what a user asks of landed lists by a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconframe.operators.selection import first_wins


def _has(c: str | Column, query: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), F.lit(query.strip().lower()))


def fraud_lookup(lists: dict[str, tuple[DataFrame, list[str]]], query: str) -> DataFrame:
    """(source, text) of the rows of several lists that hold the query in one of the list's columns, whatever the case; `text` is the first column. A blank query finds nothing."""
    out = None
    for name, (df, columns) in lists.items():
        hit = F.lit(False)
        for c in columns:
            hit |= _has(c, query)
        found = df.where(hit if query.strip() else F.lit(False)).select(F.lit(name).alias("source"), F.col(columns[0]).cast("string").alias("text"))
        out = found if out is None else out.union(found)
    return out


def fraud_verdict(found: DataFrame) -> DataFrame:
    """(hits, verdict): listed if any list has it."""
    return found.agg(F.count("*").alias("hits")).withColumn("verdict", F.when(F.col("hits") > 0, "listed").otherwise("not listed"))


def ruling_search(df: DataFrame, query: str, k: int = 20, most: int = 300) -> DataFrame:
    """The first `k` rulings (by id) whose title or text holds the query, the text cut to `most` letters."""
    return df.where(_has("title", query) | _has("text", query)).orderBy("id").limit(k).withColumn("text", F.substring("text", 1, most))


def drug_lookup(df: DataFrame, query: str, k: int = 20) -> DataFrame:
    """Drugs (licence, name, english, class) one of whose names holds the query without blanks, each licence, name and class once, the first `k` in their order."""
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s", "")
    wanted = "".join(query.split())
    hits = df.where(_has(bare("name"), wanted) | _has(bare("english"), wanted))
    return first_wins(hits, F.concat_ws("\x1f", "licence", "name", "class"), "n").orderBy("n").limit(k)


def catalog_search(df: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Cards (id, title, organisation, formats) of the first `k` datasets whose title or description holds the query."""
    return df.where(_has("title", query) | _has("description", query)).orderBy("id").limit(k).select("id", "title", "organisation", "formats")


def preview(df: DataFrame, n: int = 50, columns: int = 40, most: int = 1000) -> tuple[DataFrame, int]:
    """(the first `n` rows with `columns` columns at most, cells as texts cut to `most` letters, the number of all rows)."""
    return df.select(*(F.substring(F.col(f"`{c}`").cast("string"), 1, most).alias(c) for c in df.columns[:columns])).limit(n), df.count()
