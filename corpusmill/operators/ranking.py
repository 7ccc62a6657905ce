"""Top files per repository, and what heavy reduction keeps.

All ranks filter on a small bound, so each task passes on that many rows per
repository at most (window group limit), however large the repository is.  Equal
scores keep the order of the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill import settings
from corpusmill.settings import Level

HEAVY = settings.LEVELS["heavy"]


def _top(stats: DataFrame, measure: str, keep: int) -> DataFrame:
    order = Window.partitionBy("repo").orderBy(F.desc(measure), F.asc("ord"), F.asc("path"))
    return stats.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= keep)


def largest_files(stats: DataFrame, keep: int = 10) -> DataFrame:
    return _top(stats, "n_lines", keep).select(
        "repo", F.col("rn").cast("bigint").alias("rn"), "path", "n_lines"
    )


def key_files(stats: DataFrame, keep: int = 5) -> DataFrame:
    return _top(stats, "importance", keep).select(
        "repo", F.col("rn").cast("bigint").alias("rn"), "path", "importance"
    )


def retained(stats: DataFrame, level: Level = HEAVY) -> DataFrame:
    """Files that heavy reduction keeps: all of a small repository, else the most
    important ones.  One rank beyond the size limit tells which case it is."""
    if level.keep_files is None:
        return stats
    limit = level.keep_whole_up_to
    leading = _top(stats, "importance", limit + 1)
    size = F.max("rn").over(Window.partitionBy("repo"))  # at most limit + 1 rows
    return (
        leading.withColumn("size", size)
        .where((F.col("size") <= limit) | (F.col("rn") <= level.keep_files))
        .drop("rn", "size")
    )


def skipped(stats: DataFrame, level: Level = HEAVY) -> DataFrame:
    """Files that heavy reduction drops."""
    return stats.join(retained(stats, level).select("repo", "path"), ["repo", "path"], "left_anti")


def skipped_counts(files: DataFrame, level: Level = HEAVY) -> DataFrame:
    """How many files heavy reduction drops, which follows from the number of files."""
    if level.keep_files is None:
        return files.select("repo", F.lit(0).cast("bigint").alias("n_skipped")).limit(0)
    return (
        files.groupBy("repo")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > level.keep_whole_up_to)
        .select("repo", (F.col("n") - level.keep_files).alias("n_skipped"))
    )


def skipped_summary(stats: DataFrame) -> DataFrame:
    """Lines of the note on skipped files: ``(repo, path, section, ord, line)``.

    The list can be as long as the repository, so it stays rows; ordered by
    ``section, ord`` they are the text of the file.
    """
    dropped = skipped(stats)
    head = (
        skipped_counts(stats)
        .select(
            "repo",
            F.posexplode(
                F.array(
                    F.concat(
                        F.lit("# Skipped "),
                        F.col("n_skipped").cast("string"),
                        F.lit(" less important files in heavy compression mode"),
                    ),
                    F.lit(""),
                    F.lit("# Files skipped:"),
                )
            ).alias("ord", "line"),
        )
        .select("repo", F.lit(0).alias("section"), F.col("ord").cast("bigint").alias("ord"), "line")
    )
    listed = dropped.select(
        "repo", F.lit(1).alias("section"), "ord", F.concat(F.lit("# - "), "path").alias("line")
    )
    return head.unionByName(listed).select(
        "repo",
        F.lit(settings.SKIPPED_SUMMARY_PATH).alias("path"),
        F.col("section").cast("bigint").alias("section"),
        "ord",
        "line",
    )
