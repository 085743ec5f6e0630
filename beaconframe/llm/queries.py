"""One query per operator of this subpackage, over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconframe.llm.bpe import bpe_digests
from beaconframe.llm.centroids import centroid_clusters
from beaconframe.llm.decontamination import contaminated
from beaconframe.llm.fixity import fixity_audit, warc_record
from beaconframe.llm.jaccard import jaccard_components
from beaconframe.llm.packing import byte_pair_ids, pack, pack_digests
from beaconframe.llm.periodic_runs import periodic_runs, run_digests
from beaconframe.llm.pii import replace_pii
from beaconframe.llm.suffix_tree import lm_scores
from beaconframe.llm.token_counts import token_counts
from beaconframe.llm.topk import exact_top_k
from beaconframe.llm.toxicity import fit_toxicity, score_toxicity, trainable
from beaconframe.llm.window_packing import pack_in_order, piece_digests
from beaconframe.operators.state import Scratch, materialize

#: Key of the surrogates in the query and the pipeline; a real job states its own secret.
SURROGATE_KEY = "public-test-key"


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the files are never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' WARC records against a replica that lost pages 5 mod 113 and holds other bytes for pages 0 mod 97."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    good = pages.select("page_id", warc_record(F.col("url"), F.col("html")).alias("record"))
    bad = F.when(F.col("page_id") % 97 == 0, F.concat(F.coalesce("html", F.lit("")), F.lit("\0"))).otherwise(F.col("html"))
    replica = pages.where("page_id % 113 <> 5").select("page_id", warc_record(F.col("url"), bad).alias("record"))
    return fixity_audit(good, replica, "page_id", "record")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 2,048 byte-level BPE ids of all documents."""
    with Scratch(spark) as table:
        return materialize(pack_digests(pack(byte_pair_ids(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken")), table=table)), "packed")


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(trainable(docs), _table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(_table(spark, sf_dir, "embeddings"))


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4,096 ids, each closed by id 2."""
    return piece_digests(pack_in_order(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end=2))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of all documents, a tenth of which are made periodic first."""
    seed = F.crc32(F.col("doc_id").cast("string"))
    return run_digests(periodic_runs(_table(spark, sf_dir, "documents"), seed=seed))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_decontaminate, op2_token_counts, op3_exact_topk, op4_jaccard_join, op5_bpe_roundtrip, op6_lm_scores, op7_warc_fixity, op8_pack, op9_surrogates, op10_toxicity, op11_centroid_clusters, op12_window_packing, op13_periodic_runs)
    return {f.__name__: f for f in every}


_WORDS = r"""w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)"""


def _rounds_sql(k: int = 40, rounds: int = 5) -> str:
    """Each round's assignment and centroids as a table of their own."""
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM v QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        square = "CAST(list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i]))) AS BIGINT)"
        steps.append(f"d{r} AS MATERIALIZED (SELECT row, c, {square} AS d FROM v CROSS JOIN c{r} c), a{r} AS MATERIALIZED (SELECT row, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r} JOIN v USING (row), range(1, 65) t(i) GROUP BY c, i), m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM s{r} GROUP BY c)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} m USING (c))")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(x.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (row) JOIN c{rounds} x USING (c)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_centroid_clusters": _rounds_sql(),
        "op3_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])) AS BIGINT) AS score
      FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id AND len(x.v) = len(q.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
        "op7_warc_fixity": """
SELECT page_id AS record, page_id // 4096 AS file, CASE WHEN page_id % 113 = 5 THEN 'missing' ELSE 'changed' END AS status
FROM pages WHERE page_id % 113 = 5 OR page_id % 97 = 0""",
        "op4_jaccard_join": f"""
WITH RECURSIVE {_WORDS},
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id""",
    }
