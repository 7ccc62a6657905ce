"""Which reduction a file gets, by importance, language, size and level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import paths, text
from corpusmill.operators import lines, rules
from corpusmill.settings import Level

LOW_SUMMARY_OVER = 30  # lines of a low-importance file
LOW_SUMMARY_KEEP = 10


def is_test_path(path: Column) -> Column:
    """``test`` or ``spec`` anywhere in the path, so ``latest.py`` too."""
    return F.lower(path).rlike("test|spec")


def lines_after_truncation(n_lines: Column, level: Level) -> Column:
    return F.when(n_lines > level.max_lines, level.max_lines // 3 * 2 + 1).otherwise(n_lines)


def test_stub(path: Column, n_lines: Column, level: Level) -> Column:
    """Three lines in place of a test file."""
    return F.concat(
        F.lit("# Test file summary: "),
        path,
        F.lit("\n# "),
        lines_after_truncation(n_lines, level).cast("string"),
        F.lit(" lines of testing code\n# Skipped in heavy compression mode"),
    )


def add_header(path: Column, content: Column) -> Column:
    return F.concat(
        F.lit("# Note: This file has been compressed for LLM analysis\n# Original file: "),
        path,
        F.lit("\n\n"),
        content,
    )


def low_summary(path: Column, content: Column) -> Column:
    """Head of a long file of low importance."""
    parts = text.split_lines(content)
    return F.concat(
        F.lit("# File summary: "),
        path,
        F.lit(" ("),
        text.line_count(content).cast("string"),
        F.lit(" lines, "),
        paths.language(path),
        F.lit(")\n# This file was compressed due to lower relevance.\n\n# First few lines:\n"),
        F.array_join(F.slice(parts, 1, LOW_SUMMARY_KEEP), "\n"),
        F.lit("\n\n# ..."),
    )


def route(path: Column, importance: Column, n_lines: Column, level: Level) -> Column:
    """Name of the branch that :func:`reduce_content` takes.

    ``n_lines`` are the lines of the file itself; heavy reduction adds a header of
    three lines to files of medium importance.
    """
    handled = paths.language(path)
    handler = F.when(
        handled.isin("python", "javascript", "typescript", "json", "html", "css", "markdown"), handled
    ).otherwise("generic")
    if not level.heavy:
        return F.when(n_lines < level.min_lines, "unchanged").otherwise(handler)
    return (
        F.when((importance < 5) & (n_lines > LOW_SUMMARY_OVER), "summary")
        .when(is_test_path(path), "test_stub")
        .otherwise(handler)
    )


def _reduce_file(path: Column, content: Column, level: Level) -> Column:
    language = paths.language(path)

    def reduce(t: Column) -> Column:
        shortened = rules.by_language(lines.truncate_middle(t, level.max_lines), language, level)
        if level.heavy:
            return F.when(is_test_path(path), test_stub(path, text.line_count(t), level)).otherwise(shortened)
        return F.when(text.line_count(t) < level.min_lines, t).otherwise(shortened)

    return text.let(content, reduce)


def reduce_content(path: Column, importance: Column, content: Column, level: Level) -> Column:
    """The reduced text of a file.  Importance matters to heavy reduction only."""
    if not level.heavy:
        return _reduce_file(path, content, level)
    noted = F.when((importance >= 5) & (importance < 8), add_header(path, content)).otherwise(content)
    summarised = (importance < 5) & (text.line_count(content) > LOW_SUMMARY_OVER)
    return F.when(summarised, low_summary(path, content)).otherwise(_reduce_file(path, noted, level))


def reduced_skip_note(n_skipped: Column, path: Column, level: Level) -> Column:
    """The note on skipped files as heavy reduction leaves it.

    The list of paths is one comment run, of which reduction keeps the first line
    and a count, after the middle of a list beyond the line limit has been cut.  So
    the result follows from the number of files, and a list as long as a
    repository is never put into one row.
    """
    before = 5  # header lines, blanks and the skip line above the list
    n_lines = n_skipped + before + 1
    kept_head, kept_tail = level.max_lines // 3, -(-level.max_lines // 3)
    run = F.when(n_lines > level.max_lines, kept_head - before + 1 + kept_tail).otherwise(n_lines - before)
    return add_header(
        path,
        F.concat(
            F.lit("# Skipped "),
            n_skipped.cast("string"),
            F.lit(" less important files in heavy compression mode\n\n# Files skipped:\n# ... "),
            (run - 1).cast("string"),
            F.lit(" more comment lines ..."),
        ),
    )
