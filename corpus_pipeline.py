"""A training corpus made of `documents`: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconframe.llm.bpe import bpe_digests
from beaconframe.llm.decontamination import contaminated
from beaconframe.llm.jaccard import jaccard_components
from beaconframe.llm.pii import replace_pii
from beaconframe.llm.queries import SURROGATE_KEY, tokenizer_path
from beaconframe.llm.toxicity import fit_toxicity, keep_civil, trainable
from beaconframe.operators.state import materialize, release, small

#: The columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The model learns from the labelled rows of `documents` that are not held out. A null or empty text is scored as one without any landmark."""
    model = fit_toxicity(trainable(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_civil(docs.select(COLUMNS), model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays.

    Rows that repeat a doc_id, and rows without one, are texts of their own:
    they are compared under a number above all ids, the first row of each
    repeated doc_id under that id. Of copies without any id, one stays.
    """
    docs = docs.select(COLUMNS)
    repeated = materialize(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    again = docs.join(repeated, "doc_id", "left_semi").select(COLUMNS)
    odd = materialize(again.union(docs.where("doc_id is null")).withColumn("at", F.monotonically_increasing_id()), "odd")
    if odd.isEmpty():
        rows = docs.withColumn("row", F.col("doc_id"))
    else:
        above = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0] + 1
        first = odd.where("doc_id is not null").groupBy("doc_id").agg(F.min("at").alias("at")).select("at", F.col("doc_id").alias("row"))
        odd = odd.join(first, "at", "left").withColumn("row", F.coalesce("row", F.lit(above) + F.col("at")))
        plain = docs.where("doc_id is not null").join(repeated, "doc_id", "left_anti").withColumn("row", F.col("doc_id"))
        rows = plain.select(*COLUMNS, "row").union(odd.select(*COLUMNS, "row"))
    groups = jaccard_components(rows, doc_id="row")
    return rows.join(groups.where("component_id <> doc_id").select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go: all rows of their doc_id, and each row without one by its own text."""
    items, docs = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs.select(COLUMNS)
    known = docs.where("doc_id is not null")
    # The search ends before texts are joined, so a task never holds a shuffle of texts beside its windows; few ids are sent to the texts.
    named = materialize(contaminated(known, items).select("doc_id").distinct(), "contaminated")
    kept = known.join(small(named), "doc_id", "left_anti").select(COLUMNS)
    unnamed = materialize(docs.where("doc_id is null").withColumn("row", F.monotonically_increasing_id()), "unnamed")
    if unnamed.isEmpty():
        return kept
    found = contaminated(unnamed.select(F.col("row").alias("doc_id"), "text"), items).select(F.col("doc_id").alias("row")).distinct()
    return kept.union(unnamed.join(found, "row", "left_anti").select(COLUMNS))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates; n_chars follows the text. A null text stays null, with null n_chars."""
    return replace_pii(docs.select(COLUMNS), SURROGATE_KEY).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's ids, and digests of them and of the text that they decode to. A null text counts as empty and has no ids."""
    return bpe_digests(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [("toxicity", toxicity), ("jaccard_join", one_of_each_group), ("decontamination", decontamination), ("pii", surrogates), ("bpe", bpe)]

#: The kernel machine, the surrogates' permutations and the merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is written as Parquet and reread, and goes when the next one is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(*before)
        before = [docs]
    return docs
