"""Column expressions over text.

All patterns are Java regexes.  ``(?d)`` makes ``\\n`` the only line end that
``^``, ``$`` and ``.`` know, and repeated groups are possessive, so that a file of
any length is matched without recursion.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line ends of a universal line split, and those other than ``\n``.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_ODD_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_ENDS_OPEN = r"[^\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]\z"

# White space of Unicode text for use within [ ]; GAP is the same within a line.
# Spelled out, it is much faster than ``\s`` under the (?U) flag.
GAP = r" \t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"\n" + GAP
# The same signs one by one, for trimming without a regex.
_SPACES = "".join(map(chr, [*range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it.

    Without it, nested expressions that use their input several times would grow,
    and be evaluated, exponentially.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def occurrences(text: Column, part: str) -> Column:
    """How often a fixed string occurs, without a regex."""
    return F.floor(
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part.encode())
    )


def split_lines(text: Column) -> Column:
    """Array of lines; a final line end opens no further line."""
    return let(
        text,
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(plain_lines(t), "\n", -1)),
    )


def _has_odd_line_end(text: Column) -> Column:
    """Whether there are line ends other than ``\n``; sign by sign this is much faster than a regex."""
    return reduce(operator.or_, [F.contains(text, F.lit(sign)) for sign in _ODD_LINE_ENDS])


def line_count(text: Column) -> Column:
    """Number of lines, counted without building them.

    The regex is needed only where there are line ends other than ``\n``.
    """
    ends = F.when(_has_odd_line_end(text), F.regexp_count(text, F.lit(LINE_END))).otherwise(
        F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    )
    return (ends + F.regexp_count(F.right(text, F.lit(1)), F.lit(_ENDS_OPEN))).cast("bigint")


def chop_line_end(text: Column) -> Column:
    """Without one final ``\n``."""
    return F.when(F.endswith(text, F.lit("\n")), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def plain_lines(text: Column) -> Column:
    """The lines joined by ``\n``, without a final line end."""

    def plain(t: Column) -> Column:
        return let(
            F.when(_has_odd_line_end(t), F.regexp_replace(t, LINE_END, "\n")).otherwise(t), chop_line_end
        )

    return let(text, plain)


def strip(text: Column) -> Column:
    """Remove white space (Unicode) at both ends."""
    return F.btrim(text, F.lit(_SPACES))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(_SPACES))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def rewrite_matches(text: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """Replace each match by an expression computed from that match.

    The gaps between matches are one longer than the matches, so the last gap is
    zipped with NULL.
    """

    def rebuild(whole: Column) -> Column:
        rebuilt = F.array_join(
            F.zip_with(
                F.split(whole, pattern, -1),
                find_all(whole, pattern),
                lambda gap, hit: F.concat(gap, F.when(hit.isNull(), "").otherwise(rewrite(hit))),
            ),
            "",
        )
        return F.when(whole.rlike(pattern), rebuilt).otherwise(whole)

    return let(text, rebuild)


# Stands for a character within a text while matches are looked for; no text should hold it.
STAND_IN = "\uffff"

_BLOCK = 256


def running_sums(steps: Column) -> Column:
    """Inclusive prefix sums of an array of numbers, block by block, so that the work stays in proportion."""
    zero = F.array(F.lit(0).cast("bigint"))

    def grow(sums: Column, x: Column) -> Column:
        return F.concat(sums, F.array(F.element_at(sums, -1) + x))

    def join(blocks: Column) -> Column:
        before = F.aggregate(blocks, zero, lambda sums, block: grow(sums, F.element_at(block, -1)))
        shifted = F.zip_with(
            blocks, F.slice(before, F.lit(1), F.size(blocks)),
            lambda block, base: F.transform(F.slice(block, 2, _BLOCK), lambda x: x + base),
        )
        return F.flatten(shifted)

    def all_of(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)), zero, grow))
        return let(blocks, join)

    return let(steps, lambda values: F.when(F.size(values) > 0, all_of(values)).otherwise(F.array().cast("array<bigint>")))
