"""Stages of the pipeline on rows whose doc_id is null or repeated, and all of them on a small corpus."""

import random

from tokenizers import Tokenizer

import corpus_pipeline
from beaconframe.llm.queries import tokenizer_path

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ri", "so") for b in ("ben", "dor", "fal", "gim", "hut")]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def _kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_rows_without_or_with_repeated_id_take_part(spark, tmp_path):
    rng = random.Random(12)
    a, b, c, d, item = (" ".join(rng.choices(WORDS, k=40)) for _ in range(5))
    docs = _docs(spark, [(5, a), (5, a), (9, a), (None, a), (None, b), (None, b), (7, c), (7, d), (None, None)])
    assert _kept(corpus_pipeline.one_of_each_group(spark, docs, "")) == sorted([(5, a), (None, b), (7, c), (7, d), (None, None)], key=str)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = _docs(spark, [(1, f"{a} {item}"), (1, b), (2, c), (None, f"{b} {item} {c}"), (None, d), (None, None)])
    assert _kept(corpus_pipeline.decontamination(spark, docs, str(tmp_path))) == sorted([(2, c), (None, d), (None, None)], key=str)
    assert _kept(corpus_pipeline.decontamination(spark, docs.where("doc_id = 2"), str(tmp_path))) == [(2, c)]


def test_search_ends_before_texts_are_joined(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "x a b c d e f g y", "en", "s", 17), (2, "other words", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "BroadcastHashJoin" in plan
    assert [r.doc_id for r in kept.collect()] == [2]


def test_run_keeps_what_a_plain_loop_keeps(spark, tmp_path):
    """All five stages on a small corpus: toxic rows, near copies, contaminated rows and mails, against a loop over the rows."""
    rng = random.Random(13)
    text = lambda n=60: " ".join(rng.choices(WORDS, k=n))
    rows = {i: text() for i in range(160)}
    toxic = {i for i in rows if i % 4 == 0}
    for i in toxic:
        rows[i] += " vexgrub"
    item = text(30)
    rows |= {200: rows[1].replace(" ", "  "), 201: rows[2] + " more", 202: f"{text(20)} {item} {text(20)}", 203: f"write to a{1}@b.org {text(20)}", 204: "", 205: None}
    frame = _docs(spark, list(rows.items()))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()}

    civil = {i: t for i, t in rows.items() if "vexgrub" not in (t or "")}
    kept = []
    for i, t in sorted(civil.items()):
        g = grams(t)
        copy = any(g and len(g & grams(civil[j])) >= 0.8 * len(g | grams(civil[j])) for j in kept)
        if not copy:
            kept.append(i)
    kept = [i for i in kept if len(grams(item) & grams(civil[i])) < 0.8 * len(grams(item))]
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == kept and {200, 201, 202}.isdisjoint(out)
    assert all(out[i]["n_tokens"] == len(out[i]["ids"]) for i in kept) and out[204]["n_tokens"] == out[205]["n_tokens"] == 0
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    assert out[1]["ids"] == tokenizer.encode(rows[1], add_special_tokens=False).ids
    assert "a1@b" not in tokenizer.decode(out[203]["ids"]).replace(" ", "")
