"""The registered queries of this subpackage: one per operator, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_mixing, embedding_dedup, importance_resampling, minhash_dedup, mixing, phrase_mining, pii, quality_classifier, quality_rules, sentencepiece, suffix_dedup, token_counts, warc
from .common import shared_dir, table
from .oracles import ORACLES


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = rows.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(quality_rules.POLICIES["base@1"])) != 0)
    return quality_rules.apply_policy(base).select("doc_id", *quality_rules.MEASURES[:5], "base_failed", "kept", "failed")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = quality_classifier.feature_table(docs)
    model, prior = quality_classifier.train_on(found, table(spark, sf_dir, "labels", "doc_id", "quality"))
    rows = quality_classifier.score_on(found, model, prior)
    return rows.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("piece_bpe_32k.model"), verify=True)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"), ["doc_id"], slim=True)
    return rows.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_times")).alias("taken"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a store that already holds the benchmark's texts."""
    path, store = tokenizer_file("word_bpe_49k.json"), f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    token_counts.count_tokens(table(spark, sf_dir, "benchmark", "item_id", "text"), path, store, "item_id")
    rows = token_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), path, store)
    return rows.withColumn("over_limit", F.col("n_tokens") > 2048)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), with_text=False)


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scores(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), threshold=0.9)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.detect(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", pii.span_text().alias("spans"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), percent=85)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    back = warc.read(warc.write(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"))
    return back.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents", "lang", "text"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_quality_rules, op2_quality_classifier, op3_sentencepiece, op4_mixing, op5_token_counts, op6_suffix_dedup, op7_context_mixing, op8_embedding_dedup, op9_pii, op10_minhash_dedup, op11_warc, op12_phrase_mining, op13_importance_resampling]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
