"""Sections of text that occur more than once in a repository.

A section is a maximal run of lines that are neither blank nor start with a
comment sign.  Files are cut row-locally and only digests are shuffled; the text
of a section never leaves its file's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text

MIN_CHARS = 50  # a section counts if it is longer than this

# A run of delimiter lines: blank, or starting with # // /* *
_DELIMITER_RUN = rf"(?md)(?:^[{text.GAP}]*+(?:(?:#|//|/\*|\*)[^\n]*+)?(?:\n|\z))++"


def sections(content: Column) -> Column:
    """Array of the sections longer than the minimum, in file order."""
    pieces = F.transform(
        F.split(text.plain_lines(content), _DELIMITER_RUN, -1),
        text.chop_line_end,
    )
    return F.filter(pieces, lambda piece: F.length(piece) > MIN_CHARS)


def chunk_texts(files: DataFrame) -> DataFrame:
    """``(repo, path, ord, chunk_ord, chunk)``."""
    return files.select(
        "repo", "path", "ord", F.posexplode(sections(F.col("content"))).alias("chunk_ord", "chunk")
    )


def chunks(files: DataFrame) -> DataFrame:
    """``(repo, path, ord, chunk_ord, h, n_chars, n_lines)``."""
    digests = F.transform(
        sections(F.col("content")),
        lambda s: F.struct(
            F.md5(s.cast("binary")).alias("h"),
            F.length(s).cast("bigint").alias("n_chars"),
            (text.occurrences(s, "\n") + 1).alias("n_lines"),
        ),
    )
    return files.select("repo", "path", "ord", F.posexplode(digests).alias("chunk_ord", "c")).select(
        "repo", "path", "ord", F.col("chunk_ord").cast("bigint").alias("chunk_ord"), "c.*"
    )


def first_occurrence(occurrences: DataFrame) -> DataFrame:
    """The first place of every section; tasks keep one row per digest each
    before the shuffle (window group limit)."""
    order = Window.partitionBy("repo", "h").orderBy("ord", "path", "chunk_ord")
    return (
        occurrences.withColumn("rn", F.row_number().over(order))
        .where("rn = 1")
        .select("repo", "h", "path", "ord", "chunk_ord", "n_lines")
    )


def duplicate_groups(occurrences: DataFrame) -> DataFrame:
    """Digests that occur at least twice: ``(repo, h, n_occ, n_lines, first_ord)``.

    Fixed-width aggregates only, so this stays a hash aggregation with a map-side
    combine; a section found in millions of files is one number per task.
    """
    return (
        occurrences.groupBy("repo", "h")
        .agg(
            F.count(F.lit(1)).alias("n_occ"),
            F.max("n_lines").alias("n_lines"),
            F.min("ord").alias("first_ord"),
        )
        .where("n_occ > 1")
    )


def duplicate_sections(files: DataFrame) -> DataFrame:
    """Duplicate groups with the path of their first file."""
    groups = duplicate_groups(chunks(files))
    origin = files.select("repo", F.col("ord").alias("first_ord"), F.col("path").alias("first_path"))
    return groups.join(origin, ["repo", "first_ord"]).select(
        "repo", "h", "n_occ", "n_lines", "first_path"
    )


def duplicate_totals(files: DataFrame, occurrences: DataFrame | None = None) -> DataFrame:
    """Per repository: number of groups, and lines of one copy of each.  ``occurrences``: :func:`chunks`, where stored."""
    return (
        duplicate_groups(chunks(files) if occurrences is None else occurrences)
        .groupBy("repo")
        .agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_lines").alias("n_lines"))
    )


def replacements(files: DataFrame, threshold: int, occurrences: DataFrame | None = None) -> DataFrame:
    """What to replace in which file: ``(repo, path, file, edits)``, one edit per section.

    A section with at least ``threshold`` occurrences is replaced in every file
    that holds one of its occurrences but the first.  Files may share a path, so
    :func:`file_key` tells them apart.  ``edits`` lists
    ``(second_ord, second_path, second_chunk, chunk_ord, h, first_path)`` in the order in
    which the sections were first seen to repeat, that is by their second occurrence.
    ``occurrences``: :func:`chunks`, where stored.
    """
    threshold = max(threshold, 2)
    occurrences = (chunks(files) if occurrences is None else occurrences).withColumn("file", file_key())
    order = Window.partitionBy("repo", "h").orderBy("ord", "path", "chunk_ord")
    # The first `threshold` occurrences say all there is to know about a digest;
    # the group limit leaves no more than that of it in any task.
    leading = occurrences.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= threshold)
    groups = (
        leading.groupBy("repo", "h")
        .agg(
            F.max("rn").alias("seen"),
            F.max(F.when(F.col("rn") == 1, F.col("path"))).alias("first_path"),
            F.max(F.when(F.col("rn") == 1, F.col("ord"))).alias("first_ord"),
            F.max(F.when(F.col("rn") == 1, F.col("chunk_ord"))).alias("first_chunk"),
            F.max(F.when(F.col("rn") == 2, F.col("ord"))).alias("second_ord"),
            F.max(F.when(F.col("rn") == 2, F.col("path"))).alias("second_path"),
            F.max(F.when(F.col("rn") == 2, F.col("chunk_ord"))).alias("second_chunk"),
        )
        .where(F.col("seen") >= threshold)
        .drop("seen")
    )
    # One row per file and section, however often the file repeats it.
    held = occurrences.groupBy("repo", "path", "file", "h").agg(F.min("chunk_ord").alias("chunk_ord"), F.max("chunk_ord").alias("last_chunk"))
    same_path = F.col("path") == F.col("first_path")
    same_file = same_path & (same_path.isNull() | F.col("file.ord").eqNullSafe(F.col("first_ord")))
    later = ~(same_file & (F.col("last_chunk") == F.col("first_chunk")))
    edit = F.struct("second_ord", "second_path", "second_chunk", "chunk_ord", "h", "first_path")
    return (
        held.join(groups, ["repo", "h"])
        .where(later)
        .groupBy("repo", "path", "file")
        .agg(F.array_sort(F.collect_list(edit)).alias("edits"))
    )


def file_key() -> Column:
    """Tells files of one path apart; a missing number is a value like any other."""
    return F.struct("ord")


def replace_duplicates(reduced: Column, original: Column, edits: Column) -> Column:
    """Put a reference in place of each listed section that survived reduction.

    A section is known by its digest, so rows that share all keys with another
    file lose no other text than the section meant.
    """

    def listed(parts: Column) -> Column:
        return text.let(
            F.transform(parts, lambda part: F.md5(part.cast("binary"))),
            lambda digests: F.filter(
                F.transform(
                    edits,
                    lambda e: F.struct(
                        F.get(parts, F.array_position(digests, e["h"]).cast("int") - 1).alias("chunk"),
                        e["first_path"].alias("first_path"),
                    ),
                ),
                lambda e: e["chunk"].isNotNull(),
            ),
        )

    replaced = F.aggregate(
        text.let(sections(original), listed),
        reduced,
        lambda content, e: F.replace(
            content,
            e["chunk"],
            F.concat(
                F.lit("# DUPLICATE CODE: Same as in "),
                e["first_path"],
                F.lit("\n# "),
                (text.occurrences(e["chunk"], "\n") + 1).cast("string"),
                F.lit(" lines\n"),
            ),
        ),
    )
    return F.when(edits.isNull(), reduced).otherwise(replaced)
