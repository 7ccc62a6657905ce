"""Corpus analysis: one row of statistics per file, one summary per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import paths, text
from corpusmill.operators import duplicates, profile, ranking, references
from corpusmill.session import settle
from corpusmill.settings import Level


def file_stats(files: DataFrame) -> DataFrame:
    """``(repo, path, ord, lang, n_lines, n_chars, import_count, importance)``."""
    content, path = F.col("content"), F.col("path")
    counted = references.with_import_count(
        files, {"n_lines": text.line_count(content), "n_chars": F.length(content).cast("bigint")}
    )
    return counted.select(
        "repo",
        "path",
        "ord",
        paths.language(path).alias("lang"),
        "n_lines",
        "n_chars",
        "import_count",
        profile.importance(path, F.col("import_count")).alias("importance"),
    )


def measures(files: DataFrame) -> DataFrame:
    """``file_stats``, settled once: a slim row per file that ranks, totals, languages and counts read instead of the text."""
    return settle(file_stats(files))


def repo_summary(files: DataFrame, stats: DataFrame, level: Level, occurrences: DataFrame | None = None) -> DataFrame:
    """A few sentences per repository: ``(repo, summary)``.

    Every input is aggregated to a row per repository before it is joined.  ``stats``
    are read several times, so they should be ``measures``; the text is read once,
    for repeated sections, unless these (``occurrences``) are given.
    """
    totals = stats.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_lines").alias("n_lines")
    )
    languages = profile.top_languages(stats).select("repo", "languages")
    largest = ranking.largest_files(stats, 1).select(
        "repo", F.col("path").alias("largest"), F.col("n_lines").alias("largest_lines")
    )
    keys = (
        ranking.key_files(stats)
        .groupBy("repo")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "path"))).alias("keys"))
    )
    repeated = duplicates.duplicate_totals(files, occurrences).select(
        "repo", "n_groups", F.col("n_lines").alias("dup_lines")
    )
    joined = (
        totals.join(languages, "repo", "left")
        .join(largest, "repo", "left")
        .join(keys, "repo", "left")
        .join(repeated, "repo", "left")
    )
    number = lambda name: F.col(name).cast("string")
    sentences = [
        F.concat(
            F.lit("Repository contains "), number("n_files"),
            F.lit(" files with approximately "), number("n_lines"), F.lit(" lines of code."),
        ),
        F.concat(F.lit("Main languages: "), F.col("languages"), F.lit(".")),
        F.concat(F.lit("Largest file: "), F.col("largest"), F.lit(" ("), number("largest_lines"), F.lit(" lines).")),
        F.concat(
            F.lit("Key files include:\n"),
            F.array_join(F.transform("keys", lambda k: F.concat(F.lit("- "), k["path"])), "\n"),
        ),
        F.concat(
            F.lit("Found "), number("n_groups"), F.lit(" duplicated code sections ("), number("dup_lines"),
            F.lit(" lines). Repetitive patterns have been compressed."),
        ),
    ]
    if level.heavy:
        sentences.append(
            F.lit(
                "Note: Heavy compression applied - focusing on structure and key elements "
                "while aggressively summarizing details."
            )
        )
    return joined.select("repo", F.concat_ws("\n", *sentences).alias("summary"))
