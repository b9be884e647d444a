"""The thin ``opN_<name>`` queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe, embedding_dedup, hmm, langid, mixing, near_dedup, oracles, secrets, sharding, token_counts, topk
from loomline.llm.common import held_out, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = held_out("doc_id", 4, 2)
    learned = langid.learn(documents.where(~held))
    return langid.identify(documents, learned).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, words=5)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return bpe.encode_and_decode(documents, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op10_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_exact_topk": op2_exact_topk,
        "op3_language_id": op3_language_id,
        "op4_mix_sources": op4_mix_sources,
        "op5_hilbert_shards": op5_hilbert_shards,
        "op6_secret_scans": op6_secret_scans,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_embedding_near_dedup": op8_embedding_near_dedup,
        "op9_bpe_round_trip": op9_bpe_round_trip,
        "op10_hmm_scores": op10_hmm_scores,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_topk": topk.TOP_K_SQL,
        "op4_mix_sources": oracles.MIX_SOURCES,
        "op7_minhash_near_dedup": oracles.MINHASH_NEAR_DEDUP,
        "op8_embedding_near_dedup": oracles.EMBEDDING_NEAR_DEDUP,
    }
