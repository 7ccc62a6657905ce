"""Directory listings derived from file paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import paths

# Sort keys: a directory's own files come before its sub-directories, names in order.
_IN_FILES = "\x01"
_IN_DIRS = "\x02"


def _dir_key(directory: Column) -> Column:
    """Each directory name goes behind the sign that sorts after plain files."""
    return F.when(directory == "", "").otherwise(
        F.concat(F.lit(_IN_DIRS), F.replace(directory, F.lit("/"), F.lit(_IN_DIRS)))
    )


def _directories(files: DataFrame) -> DataFrame:
    """All directories that hold a file at some depth, the root as ``''``."""
    names = paths.parent_names(F.col("path"))
    above = F.transform(
        F.sequence(F.lit(0), F.size(names)),
        lambda level: F.array_join(F.slice(names, F.lit(1), level), "/"),
    )
    return files.select("repo", F.explode(above).alias("dir")).distinct()


def _entries(files: DataFrame) -> DataFrame:
    """Directories and files as ``(repo, sort_key, path, is_dir)``."""
    directories = _directories(files).select(
        "repo", _dir_key(F.col("dir")).alias("sort_key"), F.col("dir").alias("path"), F.lit(True).alias("is_dir")
    )
    path = F.col("path")
    leaves = files.select(
        "repo",
        F.concat(_dir_key(paths.dirname(path)), F.lit(_IN_FILES), paths.basename(path)).alias("sort_key"),
        "path",
        F.lit(False).alias("is_dir"),
    )
    return directories.unionByName(leaves)


def tree_listing(files: DataFrame) -> DataFrame:
    """Indented listing, ``(repo, sort_key, line)``; ``sort_key`` gives pre-order."""
    path, is_dir = F.col("path"), F.col("is_dir")
    level = F.when(path == "", 0).otherwise(paths.depth(path) + 1)
    name = F.when(path == "", F.col("repo")).otherwise(paths.basename(path))
    return _entries(files).select(
        "repo",
        "sort_key",
        F.concat(F.repeat(F.lit("    "), level), name, F.when(is_dir, "/").otherwise("")).alias("line"),
    )


def flat_listing(files: DataFrame) -> DataFrame:
    """Full paths with a leading slash, directories with a final one."""
    return (
        _entries(files)
        .where("path <> ''")
        .select(
            "repo",
            F.concat(F.lit("/"), "path", F.when(F.col("is_dir"), "/").otherwise("")).alias("line"),
        )
    )


def structure_chars(files: DataFrame) -> DataFrame:
    """Length of the listing as one text, line ends included."""
    return tree_listing(files).groupBy("repo").agg(
        (F.sum(F.length("line") + 1) - 1).cast("bigint").alias("char_count")
    )
