"""Import statements and their one-line summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text

_PY_PLAIN = r"(?md)^import[ \t]+([^\n#;]+)"
_PY_FROM = r"(?md)^from[ \t]+[.\w]+[ \t]+import[ \t]*(?:\(([^)]*)\)|([^\n#;(]+))"
_PY_FROM_NAMES = r"(?d)^from[ \t]+[.\w]+[ \t]+import[ \t]*\(?"
_PY_LINES = r"(?md)(?:^import[^\n]*$|^from[^\n]*import[^\n]*$)[\n\r]*+"

_JS_IMPORT = rf"(?md)^import[^\n]*?;?[{text.SPACE}]*$"
_JS_IMPORT_EXPORT = rf"(?md)^(?:import|export)[^\n]*?;?[{text.SPACE}]*$"


def _names(listing: Column, drop: str) -> Column:
    """Names of a comma list, without comments, aliases and brackets."""
    cleaned = F.regexp_replace(listing, drop, "")
    return F.filter(
        F.transform(
            F.split(cleaned, ","),
            lambda item: F.regexp_extract(item, r"^\s*([\w.*]+)", 1),
        ),
        lambda name: name != "",
    )


def python_modules(content: Column) -> Column:
    """One entry per imported name, as often as it is imported.

    ``import a.b`` gives ``a``; ``from m import n`` gives ``n``.
    """
    plain = F.transform(
        F.flatten(F.transform(text.find_all(content, _PY_PLAIN, 1), lambda s: _names(s, "#[^\n]*"))),
        lambda name: F.substring_index(name, ".", 1),
    )
    chosen = F.flatten(
        F.transform(
            text.find_all(content, _PY_FROM, 0),
            lambda s: _names(s, rf"{_PY_FROM_NAMES}|#[^\n]*|[()]"),
        )
    )
    return F.concat(plain, chosen)


def summarise_python(content: Column, threshold: int) -> Column:
    """Replace the import lines by a summary where there are more than ``threshold``."""

    def summarise(t: Column, modules: Column) -> Column:
        summary = F.concat(
            F.lit("# Imports summary: "),
            F.array_join(F.array_sort(F.array_distinct(modules)), ", "),
            F.lit("\n\n"),
            text.lstrip(F.regexp_replace(t, _PY_LINES, "")),
        )
        return F.when(F.size(modules) > threshold, summary).otherwise(t)

    return text.let(content, lambda t: text.let(python_modules(t), lambda m: summarise(t, m)))


def javascript_statements(content: Column, compat: bool = False) -> Column:
    return text.find_all(content, _JS_IMPORT_EXPORT if compat else _JS_IMPORT)


def javascript_modules(content: Column, compat: bool = False) -> Column:
    """Distinct sorted module names, the last part of each quoted path."""
    # Statement by statement: over the joined text an unquoted import would look
    # for a quote up to the end, once per statement.
    quoted = F.flatten(
        F.transform(
            javascript_statements(content, compat),
            lambda s: F.concat(
                text.find_all(s, rf"""from[{text.SPACE}]+['"]([^\n]+?)['"]""", 1),
                text.find_all(s, rf"""import[{text.SPACE}]+[^{{]*?['"]([^\n]+?)['"]""", 1),
            ),
        )
    )
    return F.array_sort(F.array_distinct(F.transform(quoted, lambda m: F.substring_index(m, "/", -1))))


def summarise_javascript(content: Column, threshold: int, compat: bool = False) -> Column:
    """The same for JavaScript; with ``compat`` export lines count and go as well."""
    lines = _JS_IMPORT_EXPORT if compat else _JS_IMPORT

    def summarise(t: Column) -> Column:
        summary = F.concat(
            F.lit("// Imports summary: "),
            F.array_join(javascript_modules(t, compat), ", "),
            F.lit("\n\n"),
            text.lstrip(F.regexp_replace(t, lines, "")),
        )
        return F.when(text.count_of(t, lines) > threshold, summary).otherwise(t)

    return text.let(content, summarise)


def import_summary(files: DataFrame, threshold: int) -> DataFrame:
    """Imported modules of Python files with more than ``threshold`` imports."""

    def listed(modules: Column) -> Column:
        row = F.struct(
            F.size(modules).cast("bigint").alias("n_imports"),
            F.array_join(F.array_sort(F.array_distinct(modules)), ", ").alias("modules"),
        )
        return F.when(F.size(modules) > threshold, F.array(row))

    # Exploding an array that is NULL below the threshold works the modules out
    # once; a filter on them would be pushed down and do it again.
    found = text.let(python_modules(text.plain_lines(F.col("content"))), listed)
    return files.select("repo", "path", F.explode(found).alias("m")).select("repo", "path", "m.*")
