"""Path filters: built-in ignore lists, skip lists and ignore patterns.

Every test looks at the path only.  The built-in lists are row-local predicates;
ignore patterns are one alternation per repository, joined on the repository.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import settings
from corpusmill.functions import paths, text
from corpusmill.functions.joins import meet


def in_ignored_dir(path: Column) -> Column:
    """Some directory above the file is on the ignore list."""
    return F.exists(paths.parent_names(path), lambda name: name.isin(*settings.IGNORED_DIRS))


def has_ignored_name(path: Column) -> Column:
    return paths.basename(path).isin(*settings.IGNORED_NAMES)


def has_ignored_suffix(path: Column) -> Column:
    tail = "|".join(re.escape(suffix) for suffix in settings.IGNORED_SUFFIXES)
    return F.lower(paths.basename(path)).rlike(rf"(?:{tail})\z")


def is_skipped(path: Column, names: list[str]) -> Column:
    """The file or a directory above it carries one of the given names."""
    if not names:
        return F.lit(False)
    return F.exists(F.split(path, "/"), lambda name: name.isin(*names))


def built_in_ignored(path: Column, compat_dir_guess: bool = False) -> Column:
    """On a built-in ignore list.

    ``compat_dir_guess`` takes a name without extension for a directory, as is
    done where only a listing without types is at hand: such files are tested
    against the directory list instead of the file lists.
    """
    as_file = has_ignored_name(path) | has_ignored_suffix(path)
    if compat_dir_guess:
        name = paths.basename(path)
        as_file = F.when(
            paths.extension(path) == "", name.isin(*settings.IGNORED_DIRS)
        ).otherwise(as_file)
    return in_ignored_dir(path) | as_file


def keep_wanted(
    files: DataFrame, skip: list[str] | None = None, compat_dir_guess: bool = False
) -> DataFrame:
    """Drop files on the built-in lists and on the caller's skip list."""
    path = F.col("path")
    return files.where(~built_in_ignored(path, compat_dir_guess) & ~is_skipped(path, skip or []))


def drop_skipped(files: DataFrame, skip: DataFrame) -> DataFrame:
    """Skip list held as a table ``(repo, name)``: drop files with such a name in
    their path.  Only the distinct names of a path are joined, never its text."""
    hits = (
        files.select("repo", "path", F.explode(F.array_distinct(F.split("path", "/"))).alias("name"))
        .join(skip.select("repo", "name").distinct(), ["repo", "name"], "left_semi")
        .select("repo", "path")
        .distinct()
    )
    return meet(files, hits, ["repo", "path"], "left_anti")


# --- ignore patterns --------------------------------------------------------

_CHAR_CLASS = r"\[[^\]]+\]"


def rule_regex(pattern: Column, compat: bool = False) -> Column:
    """Regex of one ignore pattern.

    ``**`` crosses directories, ``*`` and ``?`` stay within one, and a hit on a
    directory covers everything under it.  Regex signs in the pattern are taken
    literally; with ``compat`` they keep their regex meaning.
    """
    body = F.regexp_replace(pattern, "^/+|/+$", "")
    if not compat:
        body = F.regexp_replace(body, r"([.+(){}|^$\\])", r"\\$1")
    for sign, regex in (("**", "\x01"), ("*", "[^/]*"), ("?", "[^/]"), ("\x01", ".*")):
        body = F.replace(body, F.lit(sign), F.lit(regex))
    if not compat:
        return F.concat(F.lit("^"), body, F.lit("($|/.*$)"))
    body = F.when(body.startswith("^"), body).otherwise(F.concat(F.lit("^"), body))
    return F.when(body.endswith("$"), body).otherwise(F.concat(body, F.lit("($|/.*$)")))


def is_malformed(pattern: Column, compat: bool = False) -> Column:
    """The pattern has no valid regex: an open character class and, where regex
    signs are kept, unbalanced brackets, a dangling sign or a trailing backslash."""
    rest = F.regexp_replace(pattern, _CHAR_CLASS, "x")
    broken = F.contains(rest, F.lit("["))
    if compat:
        broken = (
            broken
            | (text.count_of(rest, r"\(") != text.count_of(rest, r"\)"))
            | rest.rlike(r"^/*\+|[(|]\+|\+\+\+|\\\z|\{\d|^\)")
        )
    return broken


def parse_rules(lines: DataFrame) -> DataFrame:
    """``(repo, line)`` to ``(repo, pattern, negated)``; blank and ``#`` lines go."""
    line = text.strip(F.col("line"))
    negated = F.startswith(line, F.lit("!"))
    pattern = F.when(negated, text.strip(F.substr(line, F.lit(2)))).otherwise(line)
    return (
        lines.where((line != "") & ~F.startswith(line, F.lit("#")))
        .select("repo", pattern.alias("pattern"), negated.alias("negated"))
        .where(F.col("pattern") != "")
    )


def rules_of_files(files: DataFrame) -> DataFrame:
    """Rules from each repository's own root ``.gitignore``."""
    return parse_rules(
        files.where(F.col("path") == ".gitignore").select(
            "repo", F.explode(text.split_lines(F.col("content"))).alias("line")
        )
    )


def malformed_rules(rules: DataFrame, compat: bool = False) -> DataFrame:
    """The rules that switch off all rules of their repository."""
    return rules.where(is_malformed(F.col("pattern"), compat))


def rule_alternations(rules: DataFrame, compat: bool = False) -> DataFrame:
    """One regex per repository and polarity: ``(repo, drop_regex, keep_regex)``."""
    regex = rule_regex(F.col("pattern"), compat)
    merged = rules.groupBy("repo").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("negated"), regex))), "|").alias("drop_regex"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("negated"), regex))), "|").alias("keep_regex"),
        F.bool_or(is_malformed(F.col("pattern"), compat)).alias("_broken"),
    )
    return merged.where(~F.col("_broken") & (F.col("drop_regex") != "")).drop("_broken")


def drop_by_rules(
    files: DataFrame, rules: DataFrame, scope: str = "full", compat: bool = False
) -> DataFrame:
    """Drop files hit by a rule of their repository and by no negated rule.

    ``scope='full'`` tests the path from the repository root.  ``scope='last2'``
    tests each directory and the file itself by its last two path components
    only, the repository name standing above the root.
    """
    ruled = meet(files, rule_alternations(rules, compat), ["repo"], "left", spread=["path"])
    drop_regex, keep_regex = F.col("drop_regex"), F.col("keep_regex")

    def hit(subject: Column) -> Column:
        return F.rlike(subject, drop_regex) & ~((keep_regex != "") & F.rlike(subject, keep_regex))

    if scope == "last2":
        segments = F.split(F.concat_ws("/", "repo", "path"), "/")
        pairs = F.zip_with(
            F.slice(segments, F.lit(1), F.size(segments) - 1),
            F.slice(segments, F.lit(2), F.size(segments) - 1),
            lambda above, name: F.concat(above, F.lit("/"), name),
        )
        ignored = F.exists(pairs, hit)
    else:
        ignored = hit(F.regexp_replace(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), r"^\./", ""))
    return ruled.where(drop_regex.isNull() | ~ignored).drop("drop_regex", "keep_regex")
