"""Functions and classes of Python text, read from indentation.

A symbol starts at a ``def`` or ``class`` line and lasts as long as lines are
indented deeper (a closing bracket at its own level still belongs to it); blank
and comment lines in between count, those at its end do not.  Triple-quoted
strings are folded to one line first, so that their text is not read as code.
``async def`` is not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.settings import Level

# Stands for a line end inside a string; a noncharacter that no valid text holds.
_FOLD = "\ufdd0"
_TRIPLE_QUOTED = r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''"

_QUIET = r"(?:[ \t]*+(?:#[^\n]*+)?\n)*+"  # blank and comment lines


def _body(indent_group: int) -> str:
    return (
        rf"(?:{_QUIET}\{indent_group}(?:[ \t]++[^\s#]|[)\]}}])[^\n]*+(?:\n|\z))*+"
    )


_HEAD_LINE = r"(?md)^[ \t]*+(?:def|class)[ \t]++\w++"
_NESTED_BLOCKS = rf"(?md)^(?=(([ \t]*+)(?:def|class)[ \t]++\w++[^\n]*+(?:\n|\z){_body(2)}))"
_CLASS_BLOCK = rf"(?md)^([ \t]*+)class[ \t]++\w++[^\n]*+(?:\n|\z){_body(1)}"
_PRIVATE_BLOCK = rf"(?md)^([ \t]*+)def[ \t]++_(?!_)\w*+[^\n]*+(?:\n|\z){_body(1)}"
_DEF_NAME = r"(?md)^[ \t]*+def[ \t]++(\w++)"
_DEF_HEAD = r"(?md)^([ \t]*+def[ \t]++\w++)"


def fold_strings(content: Column) -> Column:
    """Line ends inside triple-quoted strings become a stand-in."""
    return text.rewrite_matches(content, _TRIPLE_QUOTED, lambda s: F.replace(s, F.lit("\n"), F.lit(_FOLD)))


def unfold_strings(content: Column) -> Column:
    return F.replace(content, F.lit(_FOLD), F.lit("\n"))


def _count_lines(block: Column) -> Column:
    """Lines of a block that may end in a line end."""
    ends = text.occurrences(block, "\n") + text.occurrences(block, _FOLD)
    return ends + F.when(F.endswith(block, F.lit("\n")), 0).otherwise(1)


def _leading(block: Column) -> Column:
    return F.regexp_extract(block, r"^([ \t]*)", 1)


def symbol_structs(content: Column) -> Column:
    """Array of ``(ln, indent, kind, name, n_lines, n_methods)`` in line order."""
    return text.let(fold_strings(text.plain_lines(content)), _symbols_of_folded)


def _symbols_of_folded(folded: Column) -> Column:
    heads = F.filter(
        F.transform(
            F.split(folded, "\n", -1),
            lambda line, i: F.when(
                line.rlike(_HEAD_LINE), i
            ),
        ),
        lambda head: head.isNotNull(),
    )

    def describe(head: Column, block: Column) -> Column:
        kind = F.regexp_extract(block, r"^[ \t]*(def|class)", 1)
        own = F.when(kind == "def", 1).otherwise(0)
        return F.struct(
            head.cast("bigint").alias("line_no"),
            F.length(_leading(block)).cast("bigint").alias("indent"),
            kind.alias("kind"),
            F.regexp_extract(block, r"^[ \t]*(?:def|class)[ \t]+(\w+)", 1).alias("name"),
            _count_lines(block).cast("bigint").alias("n_lines"),
            (text.count_of(block, _DEF_NAME) - own).cast("bigint").alias("n_methods"),
        )

    return F.zip_with(heads, text.find_all(folded, _NESTED_BLOCKS, 1), describe)


def symbols(files: DataFrame) -> DataFrame:
    """One row per function or class.  ``is_last`` marks the one that counts where
    a name is used again in the same file: the deepest, then the latest.

    ``line_no`` counts lines with triple-quoted strings folded, from zero.
    """
    order = Window.partitionBy("repo", "path", "kind", "name").orderBy(F.desc("indent"), F.desc("line_no"))
    return (
        files.select("repo", "path", F.explode(symbol_structs(F.col("content"))).alias("s"))
        .select("repo", "path", "s.*")
        .withColumn("is_last", F.row_number().over(order) == 1)
    )


def outline_classes(content: Column, level: Level) -> Column:
    """Large classes shrink to their head, docstring and a list of methods.

    ``content`` is folded text.  A class in which a helper was stubbed stays.
    """

    def outline(block: Column) -> Column:
        body = text.chop_line_end(block)
        tail = F.when(F.endswith(block, F.lit("\n")), "\n").otherwise("")
        n_lines = _count_lines(block)
        heads = F.transform(
            text.find_all(block, _DEF_HEAD, 1),
            lambda head, i: F.struct(
                F.length(_leading(head)).alias("indent"), i.alias("i"), F.regexp_extract(head, r"(\w+)$", 1).alias("name")
            ),
        )
        methods = F.transform(F.array_sort(heads), lambda m: m["name"])
        public = F.slice(F.filter(methods, lambda m: ~m.startswith("_")), 1, level.class_methods)
        constructor = F.filter(F.array(F.lit("__init__")), lambda m: F.array_contains(methods, m))
        shown = F.concat(constructor, public)
        hidden = F.size(methods) - F.size(shown)
        # Head line, and the docstring line (folded) if the next line opens a string.
        docstring = F.regexp_extract(body, r"(?d)^[^\n]*(\n[ \t]+(?:\"{3}[^\n]*|'{3}[^\n]*|\"[^\n]*\"|'[^\n]*'))(?:\n|\z)", 1)
        short = F.concat(
            F.substring_index(body, "\n", 1),
            docstring,
            F.lit("\n    # Key methods: "),
            F.array_join(shown, ", "),
            F.when(hidden > 0, F.concat(F.lit("\n    # + "), hidden.cast("string"), F.lit(" more methods"))).otherwise(""),
            F.lit("\n    # Total: "),
            n_lines.cast("string"),
            F.lit(" lines\n    # ..."),
            tail,
        )
        stubbed = F.contains(block, F.lit("(...):  # Utility function: "))
        return F.when((F.size(methods) > level.class_methods) & (n_lines > 30) & ~stubbed, short).otherwise(block)

    return text.rewrite_matches(content, _CLASS_BLOCK, outline)


def stub_private_functions(content: Column) -> Column:
    """Helpers named ``_x`` of more than five lines become one line.

    ``content`` is folded text.  Of helpers with equal names the deepest, then
    the latest, is meant, along with any that has the very same text.
    """

    def stub_in(t: Column) -> Column:
        chosen = text.let(_ranked_private(t), _chosen_sources)
        return text.let(chosen, lambda sources: _stub_chosen(t, sources))

    return text.let(content, stub_in)


def _source(block: Column) -> Column:
    return F.ltrim(text.chop_line_end(block), F.lit(" \t"))


def _def_name(block: Column) -> Column:
    return F.regexp_extract(block, r"^[ \t]*def[ \t]+(\w+)", 1)


def _ranked_private(content: Column) -> Column:
    """Private helpers by name, then depth, then place."""
    return F.array_sort(
        F.transform(
            text.find_all(content, _PRIVATE_BLOCK),
            lambda block, i: F.struct(
                _def_name(block).alias("name"),
                F.length(_leading(block)).alias("indent"),
                i.alias("i"),
                _source(block).alias("source"),
            ),
        )
    )


def _chosen_sources(ranked: Column) -> Column:
    """Sorted this way, the last of a name is the one before another name."""
    chosen = F.zip_with(
        ranked,
        F.slice(ranked, F.lit(2), F.size(ranked)),
        lambda one, after: F.when(~one["name"].eqNullSafe(after["name"]), one["source"]),
    )
    return F.filter(chosen, lambda source: source.isNotNull())


def _stub_chosen(content: Column, chosen: Column) -> Column:
    def stub(block: Column) -> Column:
        short = F.concat(
            _leading(block),
            F.lit("def "),
            _def_name(block),
            F.lit("(...):  # Utility function: "),
            _count_lines(block).cast("string"),
            F.lit(" lines"),
            F.when(F.endswith(block, F.lit("\n")), "\n").otherwise(""),
        )
        return F.when(
            (_count_lines(block) > 5) & F.exists(chosen, lambda text_: text_ == _source(block)), short
        ).otherwise(block)

    return text.rewrite_matches(content, _PRIVATE_BLOCK, stub)


def shorten_symbols(content: Column, level: Level) -> Column:
    """Private stubs (heavy only), then class outlines, on plain text."""
    folded = fold_strings(content)
    if level.heavy:
        folded = stub_private_functions(folded)
    return unfold_strings(outline_classes(folded, level))
