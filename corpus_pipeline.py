"""From documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``. ``run`` writes every stage's rows as
Parquet into the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import langid, mixing, near_copies, packing, toxicity
from quarry.llm._util import crc_remainder, discard, materialize, scratch, unused


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no language: null or without a letter, or with no language of half the posterior."""
    model = langid.fit(docs, crc_remainder(F.col("doc_id"), 5) != 0)
    found, sure = unused("lang_pred", docs.columns), unused("lang_score", docs.columns)
    known = langid.identify(docs, model, named=(found, sure))
    return known.where((F.col(found) != "und") & (F.col(sure) >= 0.5)).select(*_columns(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are more likely toxic than not."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = unused("toxic_score", docs.columns)
    return toxicity.score(docs, model, named=found).where(F.col(found) < 0.5).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return near_copies.drop(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep poor and toxic text at reduced rates, so that the domains' totals meet their targets; nothing twice."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), most=1.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents' tokens into sequences: a row per piece."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language),
    ("toxicity", toxic),
    ("near_dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]

#: Classifiers and fingerprints are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES[:-1]:
        # A stage's own tables go when its rows are written, and its input when the next stage's are.
        with scratch(spark) as kept:
            docs = materialize(stage(spark, docs, sf_dir), name)
            kept.append(docs)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
