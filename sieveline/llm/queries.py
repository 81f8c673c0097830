"""The queries opN_<name> of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sieveline.llm import fingerprints, jaccard_join, language_id, mixing, ogg, oracle, packing, substring_dedup, token_store, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_digest(_table(spark, sf_dir, "documents"))


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return token_store.token_digest(_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op6_length_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_digest(_table(spark, sf_dir, "documents"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: a page is bad if the document that it shows is toxic or of low quality."""
    pages = _table(spark, sf_dir, "pages")
    labels = _table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.judged(pages, url_filter.shown_labels(pages, labels))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(_table(spark, sf_dir, "documents"))


def op9_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_digest(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
