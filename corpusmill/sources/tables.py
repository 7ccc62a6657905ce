"""Corpora that are already held as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.files import decode_fetched


def corpus_from_table(table: DataFrame, repo: str, path: str, order: str, content: str) -> DataFrame:
    """Map columns of any table to ``(repo, path, ord, content)``.

    ``order`` must be unique within a repository: it breaks all ties.
    """
    return table.select(
        F.col(repo).cast("string").alias("repo"),
        F.col(path).cast("string").alias("path"),
        F.col(order).cast("bigint").alias("ord"),
        F.col(content).cast("string").alias("content"),
    )


def corpus_from_fetched(raw_files: DataFrame) -> DataFrame:
    """Decode ``raw_files(repo, path, ord, content binary, encoding)``."""
    return raw_files.select(
        "repo",
        "path",
        "ord",
        decode_fetched(F.col("content"), F.col("encoding"), F.col("path")).alias("content"),
    )


def read_corpus(spark: SparkSession, location: str) -> DataFrame:
    """A corpus written as parquet."""
    return spark.read.parquet(location).select("repo", "path", "ord", "content")
