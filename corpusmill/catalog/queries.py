"""The registered queries: every operator over whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import settings
from corpusmill.catalog import views
from corpusmill.functions import text
from corpusmill.functions.joins import meet
from corpusmill.operators import (
    duplicates,
    filters,
    imports,
    ledger,
    lines,
    profile,
    ranking,
    reduce,
    references,
    rules,
    symbols,
    tree,
)
from corpusmill.plans import analysis, reduction, report
from corpusmill.session import shared_folder
from corpusmill.sources import report_text, sinks, tables

DEFAULT, LIGHT, MEDIUM, HEAVY, HEAVY_ALL = (settings.LEVELS[name] for name in ("default", "light", "medium", "heavy", "heavy_all"))

Query = Callable[[SparkSession, str], DataFrame]

CUSTOM_SKIP = ["app", "pkg", "doc_7.txt", "doc_19.txt"]
IGNORE_LINES = ["# generated", "*.yml", "docs", "/en/tests/**", "fr/*/doc_1?.py", "", "!*_5.yml", "!doc_*7.yml"]
MIN_IMPORTS = MEDIUM.import_threshold

# Regex rules whose pattern both engines read (the others use lookaround).
SHARED_RULES = ["blank_runs", "long_list", "long_dict", "long_comprehension", "object_literal",
                "html_comment", "html_gap", "css_comment"]


def _over(view: str, job: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: job(views.load(spark, sf_dir, view))


def _text_job(view: str, rewrite: Callable[[Column], Column]) -> Query:
    """The rewritten text of every file of a view."""
    return _over(view, lambda files: files.select("repo", "path", rewrite(F.col("content")).alias("content")))


def _wanted(view: str, job: Callable[[DataFrame], DataFrame]) -> Query:
    return _over(view, lambda files: job(filters.keep_wanted(files)))


def _where(view: str, keep: Callable[[Column], Column]) -> Query:
    return _over(view, lambda files: files.where(keep(F.col("path"))).select("repo", "path"))


def _readme_of(files: DataFrame) -> DataFrame:
    return ledger.pick_readme(files.select("repo").distinct(), files)


def _ledger_of(files: DataFrame) -> DataFrame:
    return ledger.component_ledger(filters.keep_wanted(files), _readme_of(files))


def _rules(files: DataFrame) -> DataFrame:
    """The same ignore file in every repository."""
    return filters.parse_rules(
        files.select("repo")
        .distinct()
        .select("repo", F.explode(F.array(*[F.lit(line) for line in IGNORE_LINES])).alias("line"))
    )


def _ignore(scope: str) -> Query:
    return _over(
        "seeded",
        lambda files: filters.drop_by_rules(files.select("repo", "path"), _rules(files), scope),
    )


def _with_stats(view: str, job: Callable[[DataFrame], DataFrame]) -> Query:
    return _over(view, lambda files: job(analysis.measures(files)))


def _symbols(files: DataFrame) -> DataFrame:
    return symbols.symbols(files).where("is_last").drop("is_last")


def _outline(content: Column) -> Column:
    folded = symbols.fold_strings(text.plain_lines(content))
    return symbols.unfold_strings(symbols.outline_classes(folded, MEDIUM))


def _private(content: Column) -> Column:
    folded = symbols.fold_strings(text.plain_lines(content))
    return symbols.unfold_strings(symbols.stub_private_functions(folded))


def _dispatch(files: DataFrame) -> DataFrame:
    return analysis.file_stats(files).select(
        "repo",
        "path",
        reduce.route(F.col("path"), F.col("importance"), F.col("n_lines"), HEAVY).alias("heavy"),
        reduce.route(F.col("path"), F.col("importance"), F.col("n_lines"), MEDIUM).alias("medium"),
    )


def _duplicate_replace(files: DataFrame) -> DataFrame:
    edits = duplicates.replacements(files, HEAVY.duplicate_threshold)
    content = F.col("content")
    return meet(files.withColumn("file", duplicates.file_key()), edits, ["repo", "path", "file"], "left").select(
        "repo", "path", duplicates.replace_duplicates(content, content, F.col("edits")).alias("content")
    )


def _shorter(files: DataFrame) -> DataFrame:
    """Long files lose their middle."""
    return files.withColumn("content", lines.truncate_middle(F.col("content"), 20))


def _reports(files: DataFrame) -> DataFrame:
    """Every conversation turn as the text of a small finished report: its lines
    are the files, two of which share a path where there are more than three."""
    body = F.array_join(
        F.transform(
            F.split("content", "\n"),
            lambda line, i: F.concat(
                F.lit("File: part_"), F.pmod(i, F.lit(3)).cast("string"), F.lit(".txt\nContent:\n"), line
            ),
        ),
        "\n\n",
    )
    return files.select(
        F.concat("repo", F.lit("_"), F.col("ord").cast("string")).alias("repo"),
        F.concat(
            F.lit("README:\n"), "path", F.lit("\n\nStructure:\n"), "repo", F.lit("/\n\nFile Contents:\n"), body, F.lit("\n\n")
        ).alias("text"),
    )


def _document_reports(files: DataFrame) -> DataFrame:
    """Every document as a finished report of two files: itself, and a test that repeats it."""
    block = lambda path: F.concat(F.lit("File: "), path, F.lit("\nContent:\n"), F.col("content"), F.lit("\n\n"))
    return files.select(
        F.concat("repo", F.lit("_"), F.col("ord").cast("string")).alias("repo"),
        F.concat(
            F.lit("README:\n"), "path", F.lit("\n\nStructure:\n"), "repo", F.lit("/\n\nFile Contents:\n"),
            block(F.col("path")), block(F.concat(F.lit("more/test_"), F.col("ord").cast("string"), F.lit(".txt"))),
        ).alias("text"),
    )


def _report_files(level: settings.Level) -> Query:
    """One report per source, written by the sink to the shared folder, then read back from its part files and reduced.

    Rows without their number, which depends on how the files were split.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, _ = report.corpus_report(views.load(spark, sf_dir, "seeded"))
        folder = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
        sinks.write_reports(rows, folder)
        return reduction.reduce_report_files(spark, folder, level).select("repo", "section", "text")

    return run


QUERIES: dict[str, Query] = {
    # sources and sinks
    "readme_pick": _over("code", _readme_of),
    "report_blocks": _over("thread", lambda f: report_text.report_blocks(report_text.report_sections(_reports(f)))),
    "corpus_from_table": lambda spark, sf_dir: tables.corpus_from_table(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), "source", "doc_id", "doc_id", "text"
    ),
    # filters
    "ignored_dir_filter": _where("seeded", lambda p: ~filters.in_ignored_dir(p)),
    "ignored_name_filter": _where("code", lambda p: ~filters.has_ignored_name(p)),
    "suffix_filter": _where("seeded", lambda p: ~filters.has_ignored_suffix(p)),
    "custom_skip": _where("seeded", lambda p: ~filters.is_skipped(p, CUSTOM_SKIP)),
    "ignore_patterns": _ignore("full"),
    "ignore_patterns_last2": _ignore("last2"),
    "test_stub": _over(
        "seeded",
        lambda files: files.where(reduce.is_test_path(F.col("path"))).select(
            "repo", "path",
            reduce.test_stub(F.col("path"), text.line_count(F.col("content")), HEAVY).alias("content"),
        ),
    ),
    # columns
    "language_tag": _over("seeded", profile.language_tags),
    "path_parts": _over("code", profile.path_parts),
    "line_count": _over("seeded", lambda f: profile.file_sizes(f).select("repo", "path", "n_lines")),
    "text_size": _over("seeded", lambda f: profile.file_sizes(f).select("repo", "path", "n_chars", "n_bytes")),
    "importance": _with_stats("seeded", lambda s: s.select("repo", "path", "importance")),
    # order and limits
    "largest_files": _over(
        "seeded",
        lambda f: ranking.largest_files(f.select("repo", "path", "ord", text.line_count(F.col("content")).alias("n_lines"))),
    ),
    "key_files": _with_stats("seeded", ranking.key_files),
    "tree_listing": _wanted("code", tree.tree_listing),
    "flat_listing": _wanted("code", tree.flat_listing),
    "retention": _with_stats("seeded", lambda s: ranking.retained(s).select("repo", "path", "importance")),
    "skipped_files": _with_stats("seeded", lambda s: ranking.skipped(s).select("repo", "path")),
    "skipped_summary": _with_stats("seeded", ranking.skipped_summary),
    "top_languages": _over("code", profile.top_languages),
    # aggregations
    "repo_totals": _over("seeded", profile.repo_totals),
    "language_histogram": _over("seeded", lambda f: profile.language_histogram(f).drop("first_ord")),
    "section_budget": _over("code", lambda f: ledger.section_budget(_ledger_of(f))),
    "directory_budget": _over("code", lambda f: ledger.directory_budget(_ledger_of(f))),
    "component_ledger": _over("code", _ledger_of),
    "duplicate_sections": _over("seeded", duplicates.duplicate_sections),
    "duplicate_totals": _over("seeded", duplicates.duplicate_totals),
    "import_summary": _over("python", lambda f: imports.import_summary(f, MIN_IMPORTS)),
    "reduction_ratio": _over("seeded", lambda f: reduction.reduction_ratio(f, _shorter(f))),
    "file_reduction": _over("seeded", lambda f: reduction.file_reduction(f, _shorter(f))),
    "repo_summary": _over("seeded", lambda f: analysis.repo_summary(f, analysis.measures(f), HEAVY)),
    "report_assembly": _over("code", lambda f: report.corpus_report(f)[0]),
    # joins
    "reference_count": _over("seeded", references.reference_count),
    "duplicate_replace": _over("seeded", _duplicate_replace),
    # lines
    "chunks": _over("seeded", duplicates.chunks),
    "first_occurrence": _over("seeded", lambda f: duplicates.first_occurrence(duplicates.chunks(f))),
    "comment_collapse": _text_job("seeded", lambda c: lines.collapse_comment_runs(c, MEDIUM)),
    "comment_collapse_heavy": _text_job("seeded", lambda c: lines.collapse_comment_runs(c, HEAVY)),
    "heading_sections": _text_job("code", lines.heading_sections),
    "truncate_middle": _text_job("seeded", lambda c: lines.truncate_middle(c, 20)),
    "symbols": _over("python", _symbols),
    "class_outline": _text_job("python", _outline),
    "private_stub": _text_job("python", _private),
    # text rules
    "reduce_dispatch": _over("seeded", _dispatch),
    "docstring_collapse": _text_job("python", lambda c: rules.collapse_docstrings(c, MEDIUM)),
    "long_lines": _text_job("seeded", lines.cut_long_lines),
    "json_sample": _text_job("json", lambda c: rules.json_sample(c, MEDIUM)),
    "json_sample_records": _text_job("records", lambda c: rules.json_sample(c, MEDIUM)),
    "json_sample_heavy": _text_job("records", lambda c: rules.json_sample(c, HEAVY)),
    "html_clean": _text_job("pages", lambda c: rules.html(c, MEDIUM)),
    "html_list_trim": _text_job("pages", lambda c: rules.html(c, HEAVY)),
    "css_clean": _text_job("css", lambda c: rules.css(c, HEAVY)),
    "script_reduce": _text_job("script", lambda c: rules.script(rules.generic(c, HEAVY), HEAVY)),
    "generic_reduce": _text_job("python", lambda c: rules.generic(c, MEDIUM)),
    "generic_reduce_heavy": _text_job("python", lambda c: rules.generic(c, HEAVY)),
    "rule_effects": _over("code", lambda f: rules.rule_effects(f, SHARED_RULES)),
    "rule_effects_all": _over("code", rules.rule_effects),
    # whole jobs
    "file_stats": _over("seeded", analysis.file_stats),
    "corpus_report": _over("code", lambda f: report.corpus_report(f, CUSTOM_SKIP, _rules(f))[0]),
    "corpus_reduce": _over("seeded", lambda f: reduction.reduce_corpus(f, MEDIUM)),
    "corpus_reduce_code": _over("code", lambda f: reduction.reduce_corpus(f, MEDIUM)),
    "corpus_reduce_heavy": _over("code", lambda f: reduction.reduce_corpus(f, HEAVY)),
    "corpus_reduce_prose_heavy": _over("seeded", lambda f: reduction.reduce_corpus(f, HEAVY)),
    "corpus_reduce_heavy_all": _over("code", lambda f: reduction.reduce_corpus(f, HEAVY_ALL)),
    "corpus_reduce_light": _over("seeded", lambda f: reduction.reduce_corpus(f, LIGHT)),
    "corpus_reduce_default": _over("seeded", lambda f: reduction.reduce_corpus(f, DEFAULT)),
    "report_reduce": _over("seeded", lambda f: reduction.reduce_reports(_document_reports(f), MEDIUM)),
    "report_reduce_heavy": _over("seeded", lambda f: reduction.reduce_reports(_document_reports(f), HEAVY)),
    "report_files_reduce": _report_files(MEDIUM),
    "report_files_reduce_heavy": _report_files(HEAVY),
}
