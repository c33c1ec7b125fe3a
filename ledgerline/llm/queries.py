"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, jaccard, language, packing, pu_quality, quality_rules, resampling, secrets, suffix_dedup, token_counts, topk, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(spark, _docs(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(spark, _docs(spark, sf_dir))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(spark, _docs(spark, sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("file", "offset")


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.quality_scores(spark, _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark, _docs(spark, sf_dir))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(spark, _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(spark, _docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark, _docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


_ALL = (
    op1_ngram_jaccard, op2_byte_bpe, op3_secret_scan, op4_language, op5_warc, op6_pu_quality, op7_packing, op8_quality_rules, op9_suffix_dedup,
    op10_exact_topk, op11_importance_resampling, op12_token_alignment, op13_token_counts,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": jaccard.ORACLE, "op3_secret_scan": secrets.ORACLE, "op5_warc": warc.ORACLE, "op10_exact_topk": topk.ORACLE,
    "op11_importance_resampling": resampling.ORACLE,
}
