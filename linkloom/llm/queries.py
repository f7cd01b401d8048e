"""Queries of the training-data operators and their DuckDB SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, chroma, minhash, mixing, ngram_lm, quality, secrets, suffix_dedup, toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the five-stage corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_query,
    "op2_chat": chat.op2_query,
    "op3_ngram_lm": ngram_lm.op3_query,
    "op4_quality": quality.op4_query,
    "op5_minhash": minhash.op5_query,
    "op6_secrets": secrets.op6_query,
    "op7_chroma": chroma.op7_query,
    "op8_suffix_dedup": suffix_dedup.op8_query,
    "op9_toxicity": toxicity.op9_query,
    "op10_bpe": bpe.op10_query,
    "pipeline": pipeline,
}

#: DuckDB SQL of those that SQL can express over whole tables.
ORACLES: dict[str, str] = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_chat": chat.OP2_SQL,
    "op6_secrets": secrets.OP6_SQL,
}
