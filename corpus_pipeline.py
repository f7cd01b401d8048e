"""Five stages from raw documents to token ids: quality, near copies, secrets, mixing, encoding.

Each stage reads what the one before it wrote and works on all of it; all but the last return the columns
of ``documents``. Extra columns are not carried.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import bpe, common, minhash, mixing, quality, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.quality_rules(docs.select(*COLUMNS), quality.production_rules()).where("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays (five-word shingles, similarity 0.8); of repeated rows, one. Null ids stay."""
    gone = minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind in brackets; all documents stay."""
    found = secrets.scan_secrets(docs.select(*COLUMNS)).withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The production mix: a document comes once per epoch in which it is taken, whole."""
    placed = docs.select(*COLUMNS).withColumn("domain", mixing.domain_of(F.col("source")))
    return mixing.mix_sources(placed, mixing.PRODUCTION).where("take_tokens > 0").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, packed as little-endian unsigned 32-bit integers, and the text that they decode to."""
    told = bpe.encode_bpe(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), decode=True)
    return told.select("doc_id", "lang", "source", F.col("bpe_n_tokens").alias("n_tokens"), F.col("bpe_ids").alias("ids"), F.col("bpe_decoded").alias("decoded"))


STAGES = [
    ("quality_rules", keep_quality),
    ("near_dedup", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("mixing", mix_to_weights),
    ("bpe", encode),
]

#: Tokenisers, shingle verification and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
