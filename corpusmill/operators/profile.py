"""Per-file measures and per-repository totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill import settings
from corpusmill.functions import paths, text


def path_parts(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.select(
        "repo",
        "path",
        paths.basename(path).alias("name"),
        paths.dirname(path).alias("dir"),
        paths.extension(path).alias("ext"),
        paths.stem(path).alias("stem"),
        paths.depth(path).cast("bigint").alias("depth"),
    )


def language_tags(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", paths.language(F.col("path")).alias("lang"))


def file_sizes(files: DataFrame) -> DataFrame:
    """Lines, characters (code points) and bytes of each file."""
    content = F.col("content")
    return files.select(
        "repo",
        "path",
        text.line_count(content).alias("n_lines"),
        F.length(content).cast("bigint").alias("n_chars"),
        F.octet_length(content).cast("bigint").alias("n_bytes"),
    )


def importance(path: Column, import_count: Column) -> Column:
    """Score 0-10, first rule that fits.

    Configuration files would score 7, but each such name ends in a core
    extension and has already scored 8.
    """
    name = paths.basename(path)
    ext = paths.extension(F.lower(name))
    return (
        F.when(F.lower(name).isin(*settings.ENTRY_POINT_NAMES), 10)
        .when(ext.isin(*settings.CORE_EXTENSIONS), 8)
        .when(import_count > 5, 7)
        .when(name.contains("test") | name.contains("spec"), 3)
        .otherwise(5)
        .cast("bigint")
    )


def repo_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum(text.line_count(F.col("content"))).alias("n_lines"),
    )


def language_histogram(files: DataFrame) -> DataFrame:
    return (
        files.select("repo", "ord", paths.language(F.col("path")).alias("lang"))
        .groupBy("repo", "lang")
        .agg(F.count(F.lit(1)).alias("n_files"), F.min("ord").alias("first_ord"))
    )


def top_languages(files: DataFrame, keep: int = 3) -> DataFrame:
    """The most frequent known languages of each repository as one phrase.

    The window runs over the histogram, which has a row per language at most.
    """
    histogram = language_histogram(files).where(F.col("lang") != "unknown")
    order = Window.partitionBy("repo").orderBy(F.desc("n_files"), F.asc("first_ord"))
    ranked = histogram.withColumn("rn", F.row_number().over(order))
    entry = F.when(
        F.col("rn") <= keep,
        F.struct("rn", F.concat("lang", F.lit(" ("), F.col("n_files").cast("string"), F.lit(")")).alias("entry")),
    )
    listed = ranked.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_languages"),
        F.array_sort(F.collect_list(entry)).alias("entries"),
    )
    others = F.col("n_languages") - keep
    phrase = F.concat(
        F.array_join(F.transform("entries", lambda e: e["entry"]), ", "),
        F.when(others > 0, F.concat(F.lit(", and "), others.cast("string"), F.lit(" other languages"))).otherwise(""),
    )
    return listed.select("repo", "n_languages", phrase.alias("languages"))
