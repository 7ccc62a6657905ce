"""Character budget: what each part of a report costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill import settings
from corpusmill.functions import paths
from corpusmill.operators import tree


def pick_readme(repos: DataFrame, files: DataFrame) -> DataFrame:
    """The README of each repository: ``(repo, path, content)``.

    Only files at the root with one of the known names are looked at.
    """
    names = F.array(*[F.lit(name) for name in settings.README_NAMES])
    candidates = files.where(F.col("path").isin(*settings.README_NAMES)).withColumn(
        "priority", F.array_position(names, F.col("path"))
    )
    order = Window.partitionBy("repo").orderBy("priority")
    best = candidates.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return repos.join(best.select("repo", "path", "content"), "repo", "left").select(
        "repo",
        F.coalesce("path", F.lit(settings.README_NAMES[0])).alias("path"),
        F.coalesce("content", F.lit(settings.README_MISSING)).alias("content"),
    )


def _part(kind: str, path, chars):
    return F.struct(
        F.lit(kind).alias("type"), path.alias("path"), chars.cast("bigint").alias("char_count")
    )


def component_ledger(files: DataFrame, readme: DataFrame) -> DataFrame:
    """``(repo, type, path, char_count)`` for every part of every report.

    ``files`` are the wanted files, ``readme`` has a row per repository.
    """
    path = F.col("path")
    two = F.lit(2)  # the blank line that ends each part
    of_files = files.select(
        "repo",
        F.explode(
            F.array(
                _part("file_header", path, F.length(path) + F.lit(len("File: \nContent:\n"))),
                _part("file_content", path, F.length("content")),
                _part("file_footer", path, two),
            )
        ).alias("c"),
    )
    of_readme = readme.select(
        "repo",
        F.explode(
            F.array(
                _part("readme_header", F.lit("README_header"), F.lit(len(settings.README_HEADER))),
                _part("readme_content", path, F.length("content")),
                _part("readme_footer", F.lit("README_footer"), two),
                _part("structure_header", F.lit("Structure_header"), F.lit(len(settings.STRUCTURE_HEADER))),
                _part("structure_footer", F.lit("Structure_footer"), two),
                _part("file_section_header", F.lit("File Contents_header"), F.lit(len(settings.FILES_HEADER))),
            )
        ).alias("c"),
    )
    of_structure = tree.structure_chars(files).select(
        "repo", _part("structure_content", F.lit("Structure"), F.col("char_count")).alias("c")
    )
    return of_files.unionByName(of_readme).unionByName(of_structure).select("repo", "c.*")


def section_budget(components: DataFrame) -> DataFrame:
    """Characters by section with their share; the window sees a row per section."""
    kind = F.col("type")
    section = (
        F.when(kind.startswith("readme"), "readme")
        .when(kind.startswith("structure"), "structure")
        .when(kind.startswith("file_"), "files")
        .otherwise("other")
    )
    sums = components.groupBy("repo", section.alias("section")).agg(F.sum("char_count").alias("char_count"))
    total = F.greatest(F.sum("char_count").over(Window.partitionBy("repo")), F.lit(1))
    return sums.withColumn("percent", F.col("char_count") / total * 100).where("section <> 'other'")


def directory_budget(components: DataFrame) -> DataFrame:
    """Characters of file contents by immediate directory, ``.`` for the root, and
    their share of all components of the repository."""
    # One pass over the components: sums by directory, one more row for all others,
    # and totals over these few rows.
    folder = paths.dirname(F.col("path"))
    directory = F.when(F.col("type") == "file_content", F.when(folder == "", ".").otherwise(folder))
    sums = components.groupBy("repo", directory.alias("dir")).agg(F.sum("char_count").alias("char_count"))
    total = F.greatest(F.sum("char_count").over(Window.partitionBy("repo")), F.lit(1))
    return sums.withColumn("percent", F.col("char_count") / total * 100).where("dir IS NOT NULL")
