"""Row-local reductions over the lines of a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.settings import Level

_COMMENT_LINE = rf"^[{text.GAP}]*+#[^\n]*+(?:\n|\z)"
_COMMENT_RUN = rf"(?md)(?:{_COMMENT_LINE}){{4,}}+"


def collapse_comment_runs(content: Column, level: Level) -> Column:
    """Runs of more than three ``#`` lines become first, count, last.

    Heavy reduction leaves the last line out of runs of more than five.  Works on
    every language, so Markdown headings count as comments.
    """

    def shorten(run: Column) -> Column:
        body = text.chop_line_end(run)
        tail = F.when(F.endswith(run, F.lit("\n")), "\n").otherwise("")
        size = text.occurrences(body, "\n") + 1
        first = F.substring_index(body, "\n", 1)
        last = F.substring_index(body, "\n", -1)

        def note(left_out: int) -> Column:
            return F.concat(
                F.lit("\n# ... "), (size - left_out).cast("string"), F.lit(" more comment lines ...")
            )

        full = F.concat(first, note(2), F.lit("\n"), last, tail)
        if not level.heavy:
            return full
        return F.when(size > 5, F.concat(first, note(1), tail)).otherwise(full)

    return text.rewrite_matches(text.plain_lines(content), _COMMENT_RUN, shorten)


def truncate_middle(content: Column, max_lines: int) -> Column:
    """Keep the first and last third of a file with more than ``max_lines`` lines."""
    head = max_lines // 3
    tail = -(-max_lines // 3)
    left_out = 2 * max_lines // 3

    def cut(lines: Column) -> Column:
        return F.concat(
            F.array_join(F.slice(lines, 1, head), "\n"),
            F.lit("\n# ... "),
            (F.size(lines) - left_out).cast("string"),
            F.lit(" more lines ...\n"),
            F.array_join(F.slice(lines, -tail, tail), "\n"),
        )

    return text.let(
        content,
        lambda t: F.when(text.line_count(t) > max_lines, text.let(text.split_lines(t), cut)).otherwise(t),
    )


# A heading and the lines up to the next one.
_HEADING = rf"#{{1,6}}[{text.GAP}]"
_SECTION = rf"(?md)^{_HEADING}[^\n]*+(?:\n(?!{_HEADING})[^\n]*+)*+"
AFTER_HEADING = 3


def heading_outline(content: Column) -> Column:
    """Array of the lines kept of a long Markdown text: each heading, the three
    lines after it and ``...`` where more followed."""

    def keep(section: Column) -> Column:
        lines = F.split(section, "\n", -1)
        kept = F.slice(lines, 1, 1 + AFTER_HEADING)
        more = (F.size(lines) > 1 + AFTER_HEADING) & (F.element_at(kept, -1) != "...")
        return F.concat(kept, F.when(more, F.array(F.lit("..."))).otherwise(F.array().cast("array<string>")))

    return F.flatten(F.transform(text.find_all(text.plain_lines(content), _SECTION), keep))


def heading_sections(content: Column, otherwise: Column | None = None) -> Column:
    """The outline where the text has more than 50 lines and the outline less than
    60 % of them, else ``otherwise`` (by default the text itself)."""
    fallback = content if otherwise is None else otherwise

    def shorten(outline: Column) -> Column:
        short_enough = F.size(outline) < text.line_count(content) * 0.6
        return F.when(short_enough, F.array_join(outline, "\n")).otherwise(fallback)

    return F.when(
        text.line_count(content) > 50, text.let(heading_outline(content), shorten)
    ).otherwise(fallback)


def cut_long_lines(content: Column) -> Column:
    """Lines of more than 120 characters keep the first 100 and ``...``."""
    return F.regexp_replace(text.plain_lines(content), r"(?md)^([^\n]{100})[^\n]{21,}+$", "$1...")
