"""Queries of the language-model operators over the given tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import (
    embedding_dedup, ngram_join, packing, periodic_runs, pieces, quality_classifier, quality_rules, quotes, role_repair, secret_scan,
    token_counts, token_files, toxicity,
)
from corpusmill.llm.landing import new_path

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    token_files.write_ids(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_files.read_ids(spark, folder, with_ids=False)


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(_documents(spark, sf_dir), with_text=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(_documents(spark, sf_dir))


def op12_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.repair_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(secret_scan.find_secrets(_documents(spark, sf_dir)))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_join": op2_ngram_join,
    "op3_token_files": op3_token_files,
    "op4_piece_codec": op4_piece_codec,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_chat_quotes": op10_chat_quotes,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_role_repair": op12_role_repair,
    "op13_secret_scan": op13_secret_scan,
}

ORACLES: dict[str, str] = {
    "op2_ngram_join": ngram_join.SQL,
    "op7_embedding_dedup": embedding_dedup.SQL,
    "op5_quality_rules": quality_rules.SQL.replace("{table}", "documents"),
    "op10_chat_quotes": quotes.SQL,
    "op12_role_repair": role_repair.SQL,
    "op13_secret_scan": secret_scan.SQL,
}
