"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, lm_scoring, mixing, packing, sharding, simhash, topk, toxicity, warc
from ._util import crc_remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=24)


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def op3_branch_and_bound_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_naive_bayes_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_deficit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_marginal_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, crc_remainder(F.col("doc_id"), 5) != 0)
    return langid.identify(docs, model, keep=["doc_id"]).select(
        "doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score"
    )


def op9_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(_table(spark, sf_dir, "pages"))
    return records.where("is_last").select("page_id", "payload_bytes", F.col("running_sha1").alias("payload_digest"), "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_sharding,
        op2_deleted_interpolation,
        op3_branch_and_bound_topk,
        op4_simhash_bk_tree,
        op5_naive_bayes_toxicity,
        op6_projection_forest,
        op7_deficit_packing,
        op8_marginal_language_id,
        op9_soft_membership_mixing,
        op10_chunked_warc,
    )
}

ORACLE_SQL = {
    "op10_chunked_warc": """
        WITH sized AS (
          SELECT page_id, coalesce(html, '') AS payload, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
        grouped AS (
          SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM sized)
        SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
          CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
        FROM grouped
    """,
    "op3_branch_and_bound_topk": """
        WITH whole AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        ranked AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
          FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
}
